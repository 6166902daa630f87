"""Fixed values that must equal the reference toolkit's for identical results."""

# --- fixed values: reserved vocabulary entries, in id order -------------------------------
# id 0 '<Lua heritage>', id 1 '<pad>', id 2 '</s>' (end of sentence), id 3 '<unk>'.
SPECIAL_SYMBOLS = ["<Lua heritage>", "<pad>", "</s>", "<unk>"]
BOS_LUA, PAD, EOS, UNK = 0, 1, 2, 3
NSPECIAL = 4
PAD_WORD, EOS_WORD, UNK_WORD = "<pad>", "</s>", "<unk>"

# --- fixed values: vocabulary padding words are 'madeupword' + 4-digit counter ------------
MADEUP_PREFIX = "madeupword"

# --- fixed values: the 29 code points Python's str.split() treats as whitespace -----------
# \t \n \x0b \x0c \r, U+001C..U+001F, space, U+0085, U+00A0, U+1680, U+2000..U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.  Written so both Java regex (Spark) and RE2
# (DuckDB) read it the same way.
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_RUN = WS_CLASS + "+"

# --- fixed values: line breaks of Python's built-in open() in text mode --------------------
LINE_BREAK = r"\r\n|\r|\n"

# --- fixed values: subword continuation marker and its removal form ------------------------
BPE_MARKER = "@@"
BPE_SYMBOL = "@@ "

# --- fixed values: unknown-word escape used on references before scoring ------------------
UNK_ESCAPED = "<<unk>>"
# reference unk tokens are replaced by this id in BLEU so they never match
BLEU_UNK_SENTINEL = -999
