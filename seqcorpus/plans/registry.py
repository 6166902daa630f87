"""All registered queries and oracles: the base catalog and the modules that hold query and SQL side by side."""

from seqcorpus.plans import alignments, corpora, generation  # noqa: F401
from seqcorpus.plans.catalog import REGISTRY  # noqa: F401
from seqcorpus.plans.oracle import ORACLE  # noqa: F401
