"""Text-file sources and sinks: SRC-01, SRC-04..07, SRC-11, SRC-13..18, SRC-21.

Line numbers: ``spark.read.text`` keeps file order inside a split; the lines are written once with their place in the
task that read them, and the sizes of the splits, in the order of (file path, split start), give each line its 0-based
number in its file without moving a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqcorpus.constants import NSPECIAL
from seqcorpus.plans.broadcast import maybe_broadcast, stored
from seqcorpus.plans.index import global_cumsum, global_index


def read_lines(spark: SparkSession, path, per_file: bool = True, **extra) -> DataFrame:
    """SRC-01: ``(file_path, line_no, text)``; line breaks as Python's built-in open.  With ``per_file`` false,
    lines are numbered on through a folder's files in the order of their names: one text in several parts."""
    rows = stored(spark.read.text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_bs"), F.monotonically_increasing_id().alias("_mid")))
    # a split lies in one task, in order: its lines are numbered from its first one, and only the splits' sizes are added up
    splits = rows.groupBy(F.col("file_path").alias("_f"), F.col("_bs").alias("_b")).agg(F.min("_mid").alias("_m"), F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("_f", "_b")  # one row a split
    before = F.coalesce(F.sum("_n").over((order if not per_file else Window.partitionBy("_f").orderBy("_b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = maybe_broadcast(splits.select("_f", "_b", (before - F.col("_m")).alias("_to")))
    out = rows.join(starts, (F.col("file_path") == F.col("_f")) & (F.col("_bs") == F.col("_b"))).select(
        "file_path", (F.col("_mid") + F.col("_to")).alias("line_no"), "text")
    for k, v in extra.items():
        out = out.withColumn(k, F.lit(v))
    return out


def write_lines(df: DataFrame, path: str, text_col: str = "text", order_cols: list[str] | None = None, compression: str | None = None) -> None:
    """Text sink in order (one file per range partition, names sort in order)."""
    out = df.orderBy(*order_cols) if order_cols else df
    out.select(text_col).write.mode("overwrite").text(path, compression=compression)


def write_raw(df: DataFrame, path: str, split_col: str = "split", lang_col: str = "lang", text_col: str = "text",
              order_cols: list[str] | None = None) -> None:
    """SRC-10: the original text, unchanged, under ``split=.../lang=...``; lines in the order of ``order_cols``."""
    cols = [F.col(split_col).alias("split"), F.col(lang_col).alias("lang")]
    out = df.repartitionByRange(*cols, *order_cols).sortWithinPartitions(*cols, *order_cols) if order_cols else df
    out.select(*cols, F.col(text_col).alias("value")).write.partitionBy("split", "lang").mode("errorifexists").text(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10 read back: ``(split, lang, text)``."""
    return spark.read.text(path).select("split", "lang", F.col("value").alias("text"))


def infer_language_pair(file_names: DataFrame, name_col: str = "name") -> DataFrame:
    """SRC-05: first file (by name) whose second dot-part splits into exactly two by '-'."""
    parts = F.split(F.element_at(F.split(name_col, r"\."), 2), "-")
    c = file_names.filter(F.size(F.split(name_col, r"\.")) >= 2).filter(F.size(parts) == 2)
    return c.orderBy(name_col).limit(1).select(F.element_at(parts, 1).alias("src"), F.element_at(parts, 2).alias("tgt"))


def split_names(prefixes: str, base: str = "valid") -> list[str]:
    """SRC-06: ``"a,b,c"`` → ``valid, valid1, valid2``."""
    return [base if i == 0 else f"{base}{i}" for i, _ in enumerate(prefixes.split(","))]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def split_parts(spark: SparkSession, folder: str, split: str, src: str, tgt: str, lang: str) -> list[str]:
    """SRC-04: the files ``split.src-tgt.lang`` (or ``split.tgt-src.lang``), ``split1...``, ``split2...`` until one is missing.
    A missing first part is an error."""
    out: list[str] = []
    while True:
        name = split if not out else f"{split}{len(out)}"
        found = [p for p in (f"{folder}/{name}.{pair}.{lang}" for pair in (f"{src}-{tgt}", f"{tgt}-{src}")) if _exists(spark, p)]
        if not found:
            break
        out.append(found[0])
    if not out:
        raise FileNotFoundError(f"no split {split} of {src}-{tgt} for {lang} in {folder}")
    return out


def load_split(spark: SparkSession, paths: list[str], combine: bool = True) -> DataFrame:
    """SRC-04: ``name``, ``name1``... concatenated with ``corpus_ord``; ids continue across parts."""
    parts = paths if combine else paths[:1]
    u = None
    for i, p in enumerate(parts):
        d = read_lines(spark, p, per_file=False).withColumn("corpus_ord", F.lit(i))
        u = d if u is None else u.unionByName(d)
    return global_index(u, ["corpus_ord", "line_no"], name="id")


def write_vocab(vocab: DataFrame, path: str) -> None:
    """SRC-07: ``<symbol> <count>`` per line in id order, reserved entries not written."""
    out = vocab.filter(F.col("id") >= NSPECIAL).select("id", F.concat_ws(" ", "symbol", F.col("count").cast("string")).alias("text"))
    write_lines(out, path, order_cols=["id"])


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: split at the last space; reserved entries re-added; ids follow file order."""
    lines = read_lines(spark, path, per_file=False)
    m = F.regexp_extract("text", r"^(.*) (-?\d+)$", 1)
    c = F.regexp_extract("text", r"^(.*) (-?\d+)$", 2)
    words = lines.select((F.col("line_no") + NSPECIAL).cast("int").alias("id"), m.alias("symbol"), c.cast("long").alias("count"))
    from seqcorpus.constants import SPECIAL_SYMBOLS
    spec = spark.createDataFrame([(i, s, 1) for i, s in enumerate(SPECIAL_SYMBOLS)], "id int, symbol string, count long")
    return spec.unionByName(words)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: ``src tgt`` per line, duplicates → last wins."""
    lines = read_lines(spark, path, per_file=False)
    sp = F.split("text", " ")
    return (lines.select(sp[0].alias("src"), sp[1].alias("tgt"), "line_no")
            .groupBy("src").agg(F.max_by("tgt", "line_no").alias("tgt")))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: header skipped; fields on single spaces; first = word; duplicates → last wins."""
    lines = read_lines(spark, path, per_file=False).filter(F.col("line_no") > 0)
    sp = F.split(F.rtrim("text"), " ")
    rows = lines.select(F.element_at(sp, 1).alias("symbol"),
                        F.transform(F.slice(sp, 2, F.size(sp) - 1), lambda x: x.cast("float")).alias("vector"), "line_no")
    return rows.groupBy("symbol").agg(F.max_by("vector", "line_no").alias("vector"))


def read_generation_output(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """SRC-14 (batch form): ``S-id``, ``T-id``, ``H-id\\tscore\\ttext``, ``P-id\\t...`` lines → one
    row per (id, rank) hypothesis with source/target; n-best rank = order of H lines in an id."""
    t = F.col(text_col)
    tag = F.regexp_extract(t, r"^([STHPA])-(\d+)\t", 1)
    sid = F.regexp_extract(t, r"^([STHPA])-(\d+)\t", 2).cast("long")
    rest = F.regexp_replace(t, r"^[STHPA]-\d+\t", "")
    x = lines.select("line_no", tag.alias("tag"), sid.alias("id"), rest.alias("rest")).filter(F.col("tag") != "")
    st = x.filter(F.col("tag").isin("S", "T")).groupBy("id").agg(
        F.max(F.when(F.col("tag") == "S", F.col("rest"))).alias("source"),
        F.max(F.when(F.col("tag") == "T", F.col("rest"))).alias("target"))
    from pyspark.sql import Window
    h = x.filter(F.col("tag") == "H").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("line_no")))
    h = h.select("id", "rank", F.split("rest", "\t")[0].cast("double").alias("score"),
                 F.regexp_replace("rest", r"^[^\t]*\t", "").alias("hypothesis"))
    return h.join(st, "id", "left")


def read_interactive_output(lines: DataFrame, text_col: str = "text", line_col: str = "line_no") -> DataFrame:
    """SRC-14 (interactive form): ``O\\ttext`` begins an input, whose ``H\\tscore\\ttext``, ``P\\tscores`` and ``A\\tpositions`` lines follow
    without ids -> ``(id, rank, source, score, hypothesis, pos_scores, alignment)``, id = number of the O line.  Numbered by one
    global running count, so that a long output isn't read by one task; other lines are passed over."""
    t = F.col(text_col)
    tagged = lines.select(F.col(line_col).alias("_line"), F.regexp_extract(t, r"^([OHPA])\t", 1).alias("_tag"), F.regexp_replace(t, r"^[OHPA]\t", "").alias("_rest"))
    tagged = tagged.where(F.col("_tag") != "").withColumn("_o", (F.col("_tag") == "O").cast("long"))
    rows = global_cumsum(tagged, ["_line"], "_o", name="_n", inclusive=True).withColumn("id", F.col("_n") - 1).where("id >= 0")
    # the lines of an input are few: they are gathered in order, and a hypothesis takes what follows it
    got = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_line", "_tag", "_rest"))).alias("l"))
    heads = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("i"), x["_tag"].alias("tag"), x["_rest"].alias("rest"))), lambda x: x["tag"] == "H")
    h = got.select("id", F.col("l")[0]["_rest"].alias("source"), "l", F.posexplode(heads).alias("r", "h"))
    after = F.slice("l", F.col("h.i") + 2, 2)
    of = lambda tag: F.get(F.transform(F.filter(after, lambda x: x["_tag"] == tag), lambda x: x["_rest"]), F.lit(0))
    numbers = lambda c, kind: F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: x.cast(kind))
    return h.select("id", (F.col("r") + 1).alias("rank"), "source", F.split("h.rest", "\t")[0].cast("double").alias("score"),
                    F.regexp_replace("h.rest", r"^[^\t]*\t", "").alias("hypothesis"), numbers(of("P"), "double").alias("pos_scores"),
                    numbers(of("A"), "int").alias("alignment"))


def write_generation_output(hyps: DataFrame) -> DataFrame:
    """SRC-15: ``(id, o, line)``, the printer's lines in the order of (id, o): once an id ``S-id`` and, with a target, ``T-id``; then for
    each hypothesis by ``rank`` (from 1) ``H-id\\tscore\\ttext``, ``P-id\\tscores`` (4 decimals) and, where there is a column ``alignment``,
    ``A-id\\tpositions``.  Row-local: no shuffle, the order is left to the writer."""
    head = lambda tag: F.concat(F.lit(f"{tag}-"), F.col("id").cast("string"), F.lit("\t"))
    line = lambda o, text: F.struct(o.cast("long").alias("o"), text.alias("line"))
    first, at = F.col("rank") == 1, F.col("rank").cast("long") * 3
    scores = F.array_join(F.transform("pos_scores", lambda v: F.format_string("%.4f", v)), " ")
    lines = [line(F.lit(0), F.when(first, F.concat(head("S"), "source"))), line(F.lit(1), F.when(first, F.concat(head("T"), "target"))),
             line(at, F.concat(head("H"), F.col("score").cast("string"), F.lit("\t"), "hypothesis")), line(at + 1, F.concat(head("P"), scores))]
    if "alignment" in hyps.columns:
        lines.append(line(at + 2, F.concat(head("A"), F.array_join(F.col("alignment").cast("array<string>"), " "))))
    return hyps.select("id", F.explode(F.array(*lines)).alias("l")).where("l.line IS NOT NULL").select("id", "l.o", "l.line")


def read_tagged_text(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """SRC-17: drop lines with <url>, <talkid>, <keywords>; strip <title>/<description> tags."""
    keep = lines.filter(~F.col(text_col).rlike("<url>|<talkid>|<keywords>"))
    return keep.withColumn(text_col, F.regexp_replace(text_col, "</?(title|description)>", ""))


def read_sgm_segments(lines: DataFrame, text_col: str = "text", tag: str = "seg") -> DataFrame:
    """SRC-18: keep ``<seg id...>`` lines, strip the tag and surrounding space, ’ → '."""
    keep = lines.filter(F.col(text_col).contains(f"<{tag}"))
    t = F.regexp_replace(text_col, rf"<{tag}[^>]*>\s*", "")
    t = F.regexp_replace(t, rf"\s*</{tag}>\s*", "")
    return keep.withColumn(text_col, F.replace(t, F.lit("’"), F.lit("'")))


def synthetic_lines(ids: DataFrame, id_col: str, maxlen: int, seed: int) -> DataFrame:
    """SRC-21: for each id a line of 1..maxlen random lowercase letters separated by spaces, from hashes of
    (id, position, seed), so that a line is the same wherever and whenever it is made."""
    line = F.col(id_col).cast("long")
    length = (F.pmod(F.xxhash64(line, F.lit(seed)), F.lit(maxlen)) + 1).cast("int")
    letters = F.transform(F.sequence(F.lit(1), length),
                          lambda i: F.char((F.pmod(F.xxhash64(line, i, F.lit(seed + 1)), F.lit(26)) + 97).cast("int")))
    return ids.select(line.alias("line_no"), F.array_join(letters, " ").alias("text"))


def synthetic_corpus(spark: SparkSession, n: int, maxlen: int, seed: int) -> DataFrame:
    """SRC-21 for the line numbers 0..n-1."""
    return synthetic_lines(spark.range(n), "id", maxlen, seed)
