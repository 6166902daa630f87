"""DuckDB SQL oracles for the registered queries (same output column names and types).

The tables ``documents conversations benchmark labels pages embeddings events ...`` are views.
Shared CTE fragments below spell the same semantics as the Spark code: lines are split on
``\\r\\n|\\r|\\n``, tokens on runs of the 29 Python whitespace code points.
"""

from __future__ import annotations

from seqcorpus.constants import MADEUP_PREFIX, SPECIAL_SYMBOLS, WS_RUN

WS = WS_RUN
SPECIALS_SQL = "[" + ", ".join("'" + s + "'" for s in SPECIAL_SYMBOLS) + "]"
SPECIALS_IN = "(" + ", ".join("'" + s + "'" for s in SPECIAL_SYMBOLS) + ")"


def lines_cte(cols: str = "lang") -> str:
    extra = f", {cols}" if cols else ""
    return f"""lines AS (
  SELECT doc_id{extra}, CAST(unnest(generate_series(0, len(parts) - 1)) AS BIGINT) AS line_no,
         unnest(parts) AS text
  FROM (SELECT doc_id{extra}, string_split_regex(text, '\\r\\n|\\r|\\n') AS parts FROM documents))"""


def toks_cte(src: str = "lines", keys: str = "doc_id, line_no", extra: str = ", lang") -> str:
    return f"""tl AS (
  SELECT {keys}{extra}, list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '') AS t FROM {src}),
toks AS (
  SELECT {keys}{extra}, CAST(unnest(generate_series(0, len(t) - 1)) AS BIGINT) AS pos, unnest(t) AS symbol
  FROM tl WHERE len(t) > 0)"""


def vocab_ctes(threshold: int, nwords: int, padding: int = 8, toks: str = "toks", nlines: str = "tl",
               order: str = "doc_id, line_no", p: str = "") -> str:
    """``{p}counts`` (symbol, cnt, first) and ``{p}vocab`` (id, symbol, count) as in AGG-01/04."""
    keep = f"WHERE rk <= {nwords - 4}" if nwords > 0 else ""
    fields = [c.strip() for c in order.split(",")] + ["pos"]
    first = "struct_pack(" + ", ".join(f"{c} := {c}" for c in fields) + ")"
    return f"""{p}wc AS (
  SELECT symbol, count(*) AS cnt, min({first}) AS first FROM {toks} GROUP BY symbol),
{p}counts AS (
  SELECT symbol, CAST(sum(cnt) AS BIGINT) AS cnt,
         CASE WHEN symbol IN {SPECIALS_IN} THEN NULL ELSE min(first) END AS first FROM (
    SELECT symbol, cnt, first FROM {p}wc
    UNION ALL SELECT unnest({SPECIALS_SQL}) AS symbol, 1 AS cnt, NULL AS first
    UNION ALL SELECT '</s>' AS symbol, count(*) AS cnt, NULL AS first FROM {nlines}) GROUP BY symbol),
{p}ranked AS (
  SELECT symbol, cnt, row_number() OVER (ORDER BY cnt DESC, first ASC, symbol ASC) AS rk
  FROM {p}counts WHERE symbol NOT IN {SPECIALS_IN} AND cnt >= {threshold}),
{p}kept AS (SELECT CAST(rk + 3 AS INTEGER) AS id, symbol, cnt FROM {p}ranked {keep}),
{p}spec AS (
  SELECT CAST(i - 1 AS INTEGER) AS id, s AS symbol, coalesce(c.cnt, 1) AS cnt
  FROM (SELECT unnest({SPECIALS_SQL}) AS s, unnest(generate_series(1, 4)) AS i) x
  LEFT JOIN {p}counts c ON c.symbol = x.s),
{p}base AS (SELECT * FROM {p}spec UNION ALL SELECT * FROM {p}kept),
{p}nb AS (SELECT count(*) AS n FROM {p}base),
{p}pads AS (
  SELECT CAST(n + i AS INTEGER) AS id, '{MADEUP_PREFIX}' || lpad(CAST(i AS VARCHAR), 4, '0') AS symbol, 0 AS cnt
  FROM (SELECT n, unnest(range(0, CAST(({padding} - n % {padding}) % {padding} AS BIGINT))) AS i FROM {p}nb)),
{p}vocab AS (
  SELECT id, symbol, CAST(cnt AS BIGINT) AS count FROM {p}base
  UNION ALL SELECT id, symbol, CAST(cnt AS BIGINT) AS count FROM {p}pads)"""


ORACLE: dict[str, str] = {}

ORACLE["agg_05_encode_stats"] = f"""
WITH {lines_cte()}, {toks_cte()}, {vocab_ctes(2, 30000)},
ls AS (SELECT lang, count(*) AS nseq, CAST(sum(len(t) + 1) AS BIGINT) AS ntok FROM tl GROUP BY lang),
wt AS (SELECT lang, symbol, count(*) AS n FROM toks GROUP BY lang, symbol),
us AS (SELECT lang, CAST(sum(n) AS BIGINT) AS nunk, count(*) AS replaced FROM wt
       WHERE symbol NOT IN (SELECT symbol FROM vocab) AND symbol <> '<unk>' GROUP BY lang)
SELECT ls.lang, nseq, ntok, CAST(coalesce(nunk, 0) AS BIGINT) AS nunk,
       CAST(coalesce(replaced, 0) AS BIGINT) AS replaced,
       round(100.0::DOUBLE * coalesce(nunk, 0) / ntok, 6) AS pct_replaced
FROM ls LEFT JOIN us ON ls.lang = us.lang
"""


def tok(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '{WS}'), lambda x: x <> '')"


DOC = f"{lines_cte('')}, {toks_cte(extra='')}"
DOC_LANG = f"{lines_cte()}, {toks_cte()}"

ORACLE["src_01_read_lines"] = f"WITH {lines_cte()} SELECT doc_id, line_no, lang, text FROM lines"

ORACLE["prj_01_tokenize_line"] = f"""WITH {DOC}
SELECT doc_id, line_no, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM tl"""

ORACLE["agg_01_count_words"] = f"""WITH {DOC}, {vocab_ctes(2, 30000)}
SELECT symbol, cnt AS count, first.doc_id AS first_doc, first.line_no AS first_line,
       CAST(first.pos AS BIGINT) AS first_pos FROM counts"""

ORACLE["agg_04_finalize_vocab"] = f"WITH {DOC}, {vocab_ctes(2, 30000)} SELECT * FROM vocab"
ORACLE["win_01_rank_to_id"] = f"WITH {DOC}, {vocab_ctes(2, -1)} SELECT * FROM vocab"
ORACLE["srt_05_top_n_words"] = f"""WITH {DOC}, {vocab_ctes(2, -1)}
SELECT symbol, cnt AS count FROM counts WHERE symbol NOT IN {SPECIALS_IN}
ORDER BY cnt DESC, first ASC, symbol ASC LIMIT 100"""
ORACLE["flt_09_min_count_threshold"] = f"""WITH {DOC}, {vocab_ctes(-1, -1)}
SELECT * FROM vocab WHERE count >= 5 OR symbol IN {SPECIALS_IN}"""


def lang_vocab(lang: str, p: str, threshold: int = -1) -> str:
    return f"""{p}lines AS (SELECT * FROM lines WHERE lang = '{lang}'),
{p}tl AS (SELECT doc_id, line_no, t FROM tl WHERE lang = '{lang}'),
{p}toks AS (SELECT * FROM toks WHERE lang = '{lang}'),
{vocab_ctes(threshold, -1, toks=p + 'toks', nlines=p + 'tl', p=p)}"""


ORACLE["agg_02_merge_vocab"] = f"""WITH {DOC_LANG}, {lang_vocab('en', 'a_', 3)}, {lang_vocab('fr', 'b_', 3)},
j AS (SELECT a.id, coalesce(a.symbol, b.symbol) AS symbol, a.count AS lc, b.id AS rid, b.count AS rc
      FROM a_vocab a FULL OUTER JOIN b_vocab b ON a.symbol = b.symbol)
SELECT id, symbol, CAST(lc + coalesce(rc, 0) AS BIGINT) AS count FROM j WHERE id IS NOT NULL
UNION ALL
SELECT CAST((SELECT max(id) FROM a_vocab) + row_number() OVER (ORDER BY rid) AS INTEGER) AS id, symbol,
       CAST(rc AS BIGINT) AS count FROM j WHERE id IS NULL"""

ORACLE["set_03_vocab_intersect"] = f"""WITH {DOC_LANG}, {lang_vocab('en', 'a_')}, {lang_vocab('de', 'b_')}
SELECT symbol FROM a_vocab INTERSECT SELECT symbol FROM b_vocab"""

ORACLE["set_04_vocab_equal"] = f"""WITH {DOC}, {vocab_ctes(3, 10000000, p='a_')}, {vocab_ctes(3, -1, p='b_')}
SELECT count(*) = 0 AS equal FROM (
  (SELECT symbol, id FROM a_vocab EXCEPT ALL SELECT symbol, id FROM b_vocab)
  UNION ALL
  (SELECT symbol, id FROM b_vocab EXCEPT ALL SELECT symbol, id FROM a_vocab))"""

PAIRS_CTE = """pairs AS (
  SELECT s.conv_id, s.turn, s.text AS src_text, t.text AS tgt_text
  FROM conversations s JOIN conversations t ON t.conv_id = s.conv_id AND t.turn = s.turn + 1)"""

ORACLE["agg_03_joined_vocab"] = f"""WITH {PAIRS_CTE},
sides AS (SELECT 0 AS side, conv_id, turn, src_text AS text FROM pairs
          UNION ALL SELECT 1 AS side, conv_id, turn, tgt_text AS text FROM pairs),
{toks_cte(src='sides', keys='side, conv_id, turn', extra='')},
{vocab_ctes(2, -1, order='side, conv_id, turn')}
SELECT * FROM vocab"""

ENC = f"""{DOC}, {vocab_ctes(2, 30000)},
tv AS (SELECT doc_id, line_no, pos, symbol, v.id AS vid, coalesce(v.id, 3) AS id FROM toks LEFT JOIN vocab v USING (symbol))"""

ORACLE["jn_01_encode"] = f"""WITH {ENC},
e AS (SELECT doc_id, line_no, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS s, count(*) AS n FROM tv GROUP BY ALL)
SELECT doc_id, line_no, CAST(coalesce(e.n, 0) + 1 AS BIGINT) AS n_ids, coalesce(e.s || ' 2', '2') AS ids
FROM tl LEFT JOIN e USING (doc_id, line_no)"""
ORACLE["prj_02_encode_shuffle_join"] = ORACLE["jn_01_encode"]

ORACLE["prj_03_reverse_order"] = f"""WITH {ENC},
e AS (SELECT doc_id, line_no, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos DESC) AS s FROM tv GROUP BY ALL)
SELECT doc_id, line_no, coalesce(e.s || ' 2', '2') AS ids FROM tl LEFT JOIN e USING (doc_id, line_no)"""

ORACLE["prj_04_append_eos_off"] = f"""WITH {ENC},
e AS (SELECT doc_id, line_no, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS s FROM tv GROUP BY ALL)
SELECT doc_id, line_no, coalesce(e.s, '') AS ids FROM tl LEFT JOIN e USING (doc_id, line_no)"""

ORACLE["jn_13_oov_types"] = f"""WITH {DOC_LANG}, {vocab_ctes(2, 30000)}
SELECT lang, symbol, count(*) AS n FROM toks
WHERE symbol NOT IN (SELECT symbol FROM vocab) AND symbol <> '<unk>' GROUP BY lang, symbol"""


def _decode_sql(unk_word: str) -> str:
    return f"""WITH {ENC},
e AS (SELECT doc_id, line_no,
             string_agg(CASE WHEN id = 2 THEN NULL WHEN id = 3 THEN '{unk_word}' ELSE symbol END, ' ' ORDER BY pos) AS s
      FROM tv GROUP BY ALL)
SELECT doc_id, line_no, coalesce(e.s, '') AS text FROM tl LEFT JOIN e USING (doc_id, line_no)"""


ORACLE["prj_05_decode"] = _decode_sql("<unk>")
ORACLE["prj_06_escape_unk"] = _decode_sql("<<unk>>")

ORACLE["jn_02_id_to_symbol"] = f"""WITH {ENC}
SELECT doc_id, line_no, pos, CAST(id AS INTEGER) AS id, CASE WHEN vid IS NULL THEN '<unk>' ELSE symbol END AS symbol
FROM tv
UNION ALL
SELECT doc_id, line_no, CAST(len(t) AS BIGINT) AS pos, CAST(2 AS INTEGER) AS id, '</s>' AS symbol FROM tl"""


# ---------------------------------------------------------------- BLEU / ROUGE
def _side(col: str, ref: bool) -> str:
    lead = f"list_concat({col}, ['</s>'])"
    a = f"{lead}[list_position(list_transform({lead}, lambda x: x <> '<pad>'), true):]"
    return a, ref


BLEU_SIDES = f"""{PAIRS_CTE},
ptok AS (SELECT conv_id, turn, {tok('src_text')} AS ref, {tok('tgt_text')} AS hyp FROM pairs),
s0 AS (SELECT conv_id, turn, ref, hyp, list_concat(ref, ['</s>']) AS r0, list_concat(hyp, ['</s>']) AS h0 FROM ptok),
s1 AS (SELECT conv_id, turn, ref, hyp,
         r0[list_position(list_transform(r0, lambda x: x <> '<pad>'), true):] AS r1,
         h0[list_position(list_transform(h0, lambda x: x <> '<pad>'), true):] AS h1 FROM s0),
sides AS (SELECT conv_id, turn, ref, hyp,
   list_transform(r1[1:greatest(1, list_max(list_transform(r1, lambda x, i: CASE WHEN x IN ('</s>', '<pad>') THEN 0 ELSE i END)))],
                  lambda x: CASE WHEN x = '<unk>' THEN chr(1) || 'unk' ELSE x END) AS r,
   h1[1:greatest(1, list_max(list_transform(h1, lambda x, i: CASE WHEN x IN ('</s>', '<pad>') THEN 0 ELSE i END)))] AS h
   FROM s1)"""


def clip_ctes(src: str, r: str, h: str, orders=(1, 2, 3, 4), p: str = "") -> str:
    vals = ", ".join(f"({n})" for n in orders)
    return f"""{p}grams AS (
  SELECT conv_id, turn, n, g, sum(rr) AS r, sum(hh) AS h FROM (
    SELECT conv_id, turn, n, array_to_string({r}[i:i + n - 1], ' ') AS g, 1 AS rr, 0 AS hh
    FROM (SELECT conv_id, turn, {r}, n, unnest(generate_series(1, len({r}) - n + 1)) AS i
          FROM {src}, (VALUES {vals}) v(n))
    UNION ALL
    SELECT conv_id, turn, n, array_to_string({h}[i:i + n - 1], ' ') AS g, 0 AS rr, 1 AS hh
    FROM (SELECT conv_id, turn, {h}, n, unnest(generate_series(1, len({h}) - n + 1)) AS i
          FROM {src}, (VALUES {vals}) v(n))
  ) GROUP BY ALL),
{p}m AS (SELECT conv_id, turn, n, CAST(sum(least(r, h)) AS BIGINT) AS match FROM {p}grams GROUP BY ALL)"""


STATS = f"""{BLEU_SIDES}, {clip_ctes('sides', 'r', 'h')},
stats AS (
  SELECT s.conv_id, s.turn, CAST(len(r) AS BIGINT) AS reflen, CAST(len(h) AS BIGINT) AS predlen,
""" + ",\n".join(
    f"    CAST(coalesce((SELECT match FROM m WHERE m.conv_id = s.conv_id AND m.turn = s.turn AND m.n = {n}), 0) AS BIGINT) AS match{n},"
    f" CAST(greatest(len(h) - {n - 1}, 0) AS BIGINT) AS count{n}" for n in range(1, 5)) + """
  FROM sides s)"""

ORACLE["agg_08_bleu_stats"] = f"WITH {STATS} SELECT * FROM stats"
ORACLE["jn_08_ngram_clip_match"] = f"WITH {BLEU_SIDES}, {clip_ctes('sides', 'r', 'h')} SELECT conv_id, turn, CAST(n AS INTEGER) AS n, match FROM m"


def _score_sql(src: str, group: str = "", one_init: bool = False) -> str:
    sel_group = f"{group}, " if group else ""
    add = 1 if one_init else 0
    sums = ", ".join([f"CAST(sum(reflen) AS DOUBLE) AS reflen", "CAST(sum(predlen) AS DOUBLE) AS predlen"] +
                     [f"CAST(sum(match{n}) AS DOUBLE) + {add if n > 1 else 0} AS match{n}, "
                      f"CAST(sum(count{n}) AS DOUBLE) + {add if n > 1 else 0} AS count{n}" for n in range(1, 5)])
    precs = ", ".join(f"CASE WHEN count{n} > 0 THEN match{n} / count{n} ELSE 0 END AS p{n}" for n in range(1, 5))
    return f"""agg AS (SELECT {sel_group}{sums} FROM {src} {'GROUP BY ' + group if group else ''}),
pr AS (SELECT *, {precs} FROM agg),
scores AS (SELECT {sel_group}
  round(CASE WHEN predlen <= 0 THEN NULL WHEN p1 <= 0 OR p2 <= 0 OR p3 <= 0 OR p4 <= 0 THEN 0.0
        ELSE least(1.0, exp(1 - reflen / predlen)) * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) * 100 END, 6) AS bleu,
  round(p1 * 100, 6) AS p1, round(p2 * 100, 6) AS p2, round(p3 * 100, 6) AS p3, round(p4 * 100, 6) AS p4,
  round(CASE WHEN predlen > 0 THEN least(1.0, exp(1 - reflen / predlen)) END, 6) AS bp,
  round(CASE WHEN reflen > 0 THEN predlen / reflen END, 6) AS ratio,
  CAST(predlen AS BIGINT) AS syslen, CAST(reflen AS BIGINT) AS reflen FROM pr)"""


ORACLE["agg_09_corpus_bleu"] = f"WITH {STATS}, {_score_sql('stats')} SELECT * FROM scores"
ORACLE["agg_10_bleu_report"] = f"""WITH {STATS}, {_score_sql('stats')}
SELECT printf('BLEU%d = %.2f, %.1f/%.1f/%.1f/%.1f (BP=%.3f, ratio=%.3f, syslen=%d, reflen=%d)',
              4, bleu, p1, p2, p3, p4, bp, ratio, syslen, reflen) AS report FROM scores"""

ORACLE["agg_11_sentence_bleu"] = f"""WITH {STATS},
pr AS (SELECT conv_id, turn, CAST(reflen AS DOUBLE) AS reflen, CAST(predlen AS DOUBLE) AS predlen,
  CASE WHEN count1 > 0 THEN match1 / count1 ELSE 0 END AS p1,
  (match2 + 1.0) / (count2 + 1.0) AS p2, (match3 + 1.0) / (count3 + 1.0) AS p3, (match4 + 1.0) / (count4 + 1.0) AS p4
  FROM stats)
SELECT conv_id, turn, round(CASE WHEN predlen <= 0 THEN NULL WHEN p1 <= 0 OR p2 <= 0 OR p3 <= 0 OR p4 <= 0 THEN 0.0
   ELSE least(1.0, exp(1 - reflen / predlen)) * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) * 100 END, 6) AS bleu
FROM pr"""

ORACLE["scr_07_select_checkpoint"] = f"""WITH {STATS},
st AS (SELECT stats.*, c.role AS system FROM stats JOIN conversations c ON c.conv_id = stats.conv_id AND c.turn = stats.turn + 1),
{_score_sql('st', 'system')}
SELECT (SELECT system FROM scores ORDER BY bleu DESC, system DESC LIMIT 1) AS best_system,
       max(bleu) AS best_bleu, count(*) AS n_systems FROM scores"""

ORACLE["agg_12_multi_ref_bleu"] = f"""WITH conv AS (SELECT conv_id, turn, list_transform({tok('text')}, lambda x: lower(x)) AS tok FROM conversations),
keys AS (SELECT a.conv_id, a.turn FROM conv a JOIN conv b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
hyps AS (SELECT k.conv_id, k.turn, b.tok AS hyp FROM keys k JOIN conv b ON b.conv_id = k.conv_id AND b.turn = k.turn + 1),
refs AS (SELECT k.conv_id, k.turn, 0 AS ref_no, a.tok AS ref FROM keys k JOIN conv a ON a.conv_id = k.conv_id AND a.turn = k.turn
         UNION ALL
         SELECT k.conv_id, k.turn, 1 AS ref_no, c.tok AS ref FROM keys k JOIN conv c ON c.conv_id = k.conv_id AND c.turn = k.turn + 2),
closest AS (SELECT h.conv_id, h.turn, first(len(r.ref) ORDER BY abs(len(r.ref) - len(h.hyp)), len(r.ref)) AS reflen
            FROM hyps h JOIN refs r USING (conv_id, turn) GROUP BY ALL),
hg AS (SELECT conv_id, turn, n, g, count(*) AS hc FROM (
         SELECT conv_id, turn, n, array_to_string(hyp[i:i + n - 1], ' ') AS g FROM (
           SELECT conv_id, turn, hyp, n, unnest(generate_series(1, len(hyp) - n + 1)) AS i
           FROM hyps, (VALUES (1), (2), (3), (4)) v(n))) GROUP BY ALL),
rg AS (SELECT conv_id, turn, n, g, max(rc) AS rc FROM (
         SELECT conv_id, turn, ref_no, n, g, count(*) AS rc FROM (
           SELECT conv_id, turn, ref_no, n, array_to_string(ref[i:i + n - 1], ' ') AS g FROM (
             SELECT conv_id, turn, ref_no, ref, n, unnest(generate_series(1, len(ref) - n + 1)) AS i
             FROM refs, (VALUES (1), (2), (3), (4)) v(n))) GROUP BY ALL) GROUP BY ALL),
mm AS (SELECT hg.conv_id, hg.turn, hg.n, sum(least(hc, coalesce(rc, 0))) AS match, sum(hc) AS cnt
       FROM hg LEFT JOIN rg USING (conv_id, turn, n, g) GROUP BY ALL),
stats AS (SELECT h.conv_id, h.turn, CAST(coalesce(c.reflen, 0) AS BIGINT) AS reflen, CAST(len(h.hyp) AS BIGINT) AS predlen,
""" + ",\n".join(
    f"  CAST(coalesce((SELECT match FROM mm WHERE mm.conv_id = h.conv_id AND mm.turn = h.turn AND mm.n = {n}), 0) AS BIGINT) AS match{n},"
    f" CAST(coalesce((SELECT cnt FROM mm WHERE mm.conv_id = h.conv_id AND mm.turn = h.turn AND mm.n = {n}), 0) AS BIGINT) AS count{n}"
    for n in range(1, 5)) + f"""
  FROM hyps h LEFT JOIN closest c USING (conv_id, turn)),
{_score_sql('stats')}
SELECT * FROM scores"""


def _rouge_n_sql() -> str:
    parts = []
    for n in (1, 2):
        parts.append(f"""r{n} AS (
  SELECT s.conv_id, s.turn,
    CAST(coalesce(m.match, 0) AS DOUBLE) AS mt, greatest(len(ref) - {n - 1}, 0) AS rn, greatest(len(hyp) - {n - 1}, 0) AS hn
  FROM sides s LEFT JOIN rm{n}m m ON m.conv_id = s.conv_id AND m.turn = s.turn AND m.n = {n}),
f{n} AS (SELECT conv_id, turn,
  CASE WHEN rn > 0 THEN mt / rn ELSE 0 END AS rec, CASE WHEN hn > 0 THEN mt / hn ELSE 0 END AS prec FROM r{n}),
g{n} AS (SELECT conv_id, turn, CASE WHEN rec + prec > 0 THEN 2 * rec * prec / (rec + prec) ELSE 0 END AS f1 FROM f{n})""")
    return ",\n".join(parts)


ORACLE["agg_13_rouge_n"] = f"""WITH {BLEU_SIDES}, {clip_ctes('sides', 'ref', 'hyp', (1,), 'rm1')}, {clip_ctes('sides', 'ref', 'hyp', (2,), 'rm2')},
{_rouge_n_sql()}
SELECT round(avg(g1.f1), 6) AS rouge1, round(avg(g2.f1), 6) AS rouge2, count(*) AS n_pairs
FROM g1 JOIN g2 USING (conv_id, turn)"""


# ---------------------------------------------------------------- parallel reads, filters, batching
ORACLE["src_02_parallel_read"] = f"""WITH {PAIRS_CTE}
SELECT conv_id, turn, CAST(length(src_text) AS BIGINT) AS src_chars, CAST(length(tgt_text) AS BIGINT) AS tgt_chars FROM pairs"""

OUTER_CTE = """op AS (
  SELECT coalesce(s.conv_id, t.conv_id) AS conv_id, coalesce(s.turn, t.turn - 1) AS turn, s.text AS src_text, t.text AS tgt_text
  FROM conversations s FULL OUTER JOIN conversations t ON t.conv_id = s.conv_id AND t.turn = s.turn + 1)"""

ORACLE["src_02_parallel_read_outer"] = f"""WITH {OUTER_CTE}
SELECT conv_id, turn, CAST(length(src_text) AS BIGINT) AS src_chars, CAST(length(tgt_text) AS BIGINT) AS tgt_chars FROM op"""

ORACLE["src_03_multiway_read"] = f"""WITH {PAIRS_CTE}
SELECT p.conv_id, p.turn, CAST(length(src_text) AS BIGINT) AS src_chars, CAST(length(tgt_text) AS BIGINT) AS tgt_chars,
       CAST(length(v.text) AS BIGINT) AS pivot_chars
FROM pairs p LEFT JOIN conversations v ON v.conv_id = p.conv_id AND v.turn = p.turn + 2"""

ORACLE["src_19_write_joined"] = f"""WITH {OUTER_CTE},
l AS (SELECT conv_id, turn, trim(coalesce(src_text, '')) || ' ||| ' || trim(coalesce(tgt_text, '')) AS line FROM op)
SELECT conv_id, turn, md5(line) AS line_md5, CAST(length(line) AS BIGINT) AS n_chars FROM l"""

PLEN = f"""{PAIRS_CTE},
plen AS (SELECT conv_id, turn, CAST(len({tok('src_text')}) + 1 AS INTEGER) AS src_len,
                CAST(len({tok('tgt_text')}) + 1 AS INTEGER) AS tgt_len FROM pairs)"""

ORACLE["prj_23_num_tokens"] = f"WITH {PLEN} SELECT conv_id, turn, src_len, tgt_len, greatest(src_len, tgt_len) AS num_tokens FROM plen"
ORACLE["flt_01_valid_size"] = f"WITH {PLEN} SELECT * FROM plen WHERE src_len <= 256 AND tgt_len <= 256"
ORACLE["flt_02_invalid_report"] = f"""WITH {PLEN},
bad AS (SELECT * FROM plen WHERE NOT (src_len <= 128 AND tgt_len <= 128)),
first10 AS (SELECT conv_id FROM bad ORDER BY src_len, tgt_len, conv_id, turn LIMIT 10)
SELECT CAST((SELECT count(*) FROM bad) AS BIGINT) AS n_invalid,
       coalesce((SELECT string_agg(CAST(conv_id AS VARCHAR), ' ') FROM first10), '') AS first_conv_ids"""
ORACLE["flt_03_clean_corpus"] = f"""WITH {PAIRS_CTE},
w AS (SELECT conv_id, turn, len({tok('src_text')}) AS s, len({tok('tgt_text')}) AS t FROM pairs)
SELECT conv_id, turn, CAST(s AS BIGINT) AS src_words, CAST(t AS BIGINT) AS tgt_words FROM w
WHERE s >= 1 AND s <= 175 AND t >= 1 AND t <= 175 AND s / t <= 1.5 AND t / s <= 1.5"""
ORACLE["flt_04_modulo_split"] = f"""WITH {PAIRS_CTE}
SELECT conv_id, turn, CASE WHEN (row_number() OVER (ORDER BY conv_id, turn)) % 23 = 0 THEN 'valid' ELSE 'train' END AS split
FROM pairs"""
ORACLE["srt_01_length_order"] = f"""WITH {PLEN}
SELECT *, row_number() OVER (ORDER BY src_len, tgt_len, conv_id, turn) - 1 AS ord FROM plen"""


def batches_cte(max_tokens: int = 4500, mult: int = 8, cap: int = 1024) -> str:
    """Greedy token-budget batching replayed row by row with a recursive CTE."""
    return f"""{PLEN},
ranked AS (SELECT conv_id, turn, src_len, tgt_len, greatest(src_len, tgt_len) AS cost,
                  CAST(row_number() OVER (ORDER BY src_len, tgt_len, conv_id, turn) - 1 AS BIGINT) AS rk
           FROM plen WHERE src_len <= {cap} AND tgt_len <= {cap}),
st AS (
  SELECT CAST(-1 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS batch, CAST([] AS INTEGER[]) AS lens,
         CAST(0 AS BIGINT) AS nb, CAST([] AS BIGINT[]) AS emitted, CAST(-1 AS BIGINT) AS eb
  UNION ALL
  SELECT r, CASE WHEN is_full THEN batch[m + 1:] ELSE batch END || [r],
            CASE WHEN is_full THEN lens[m + 1:] ELSE lens END || [cost],
            nb + CASE WHEN is_full THEN 1 ELSE 0 END,
            CASE WHEN is_full THEN batch[1:m] ELSE CAST([] AS BIGINT[]) END, nb
  FROM (
    SELECT c.rk AS r, c.cost, st.batch, st.lens, st.nb,
           len(st.batch) > 0 AND (len(st.batch) + 1) * greatest(coalesce(list_max(st.lens), 0), c.cost) > {max_tokens} AS is_full,
           greatest({mult} * (len(st.batch) // {mult}), len(st.batch) % {mult}) AS m
    FROM st JOIN ranked c ON c.rk = st.r + 1)),
assign AS (
  SELECT unnest(emitted) AS rk, eb AS batch_id, CAST(unnest(generate_series(0, len(emitted) - 1)) AS INTEGER) AS pos_in_batch
  FROM st WHERE len(emitted) > 0
  UNION ALL
  SELECT unnest(batch) AS rk, nb AS batch_id, CAST(unnest(generate_series(0, len(batch) - 1)) AS INTEGER) AS pos_in_batch
  FROM st WHERE r = (SELECT max(r) FROM st) AND len(batch) > 0),
batched AS (SELECT c.conv_id, c.turn, c.src_len, c.tgt_len, a.batch_id, a.pos_in_batch FROM ranked c JOIN assign a USING (rk))"""


BATCHES = "WITH RECURSIVE " + batches_cte()[0:]

ORACLE["bat_01_token_budget_batches"] = BATCHES + " SELECT conv_id, turn, batch_id, pos_in_batch FROM batched"
ORACLE["agg_29_batch_ntokens"] = BATCHES + """ SELECT batch_id, count(*) AS n_rows, max(src_len) AS max_src,
  CAST(sum(tgt_len) AS BIGINT) AS ntokens, max(tgt_len) AS max_tgt FROM batched GROUP BY batch_id"""
ORACLE["bat_06_maxlen_bound"] = BATCHES + """ SELECT batch_id, CAST(trunc(1.2 * max(src_len) + 10) AS BIGINT) AS maxlen
  FROM batched GROUP BY batch_id"""
ORACLE["bat_03_shard"] = BATCHES + """,
nbat AS (SELECT count(DISTINCT batch_id) AS b FROM batched),
grid AS (SELECT unnest(range(0, CAST(((b + 2) // 3) * 3 AS BIGINT))) AS i FROM nbat)
SELECT CAST(i % 3 AS INTEGER) AS shard, CAST(i // 3 AS BIGINT) AS slot,
       CASE WHEN i IN (SELECT batch_id FROM batched) THEN i END AS batch_id FROM grid"""
ORACLE["bat_04_accumulate"] = BATCHES + """ SELECT DISTINCT batch_id, CAST(floor(batch_id / 4) AS BIGINT) AS update_id FROM batched"""


# ---------------------------------------------------------------- token blocks
STREAM_TOKENS = f"""{DOC_LANG}, {vocab_ctes(2, 30000)},
tv AS (SELECT lang, doc_id, line_no, pos, coalesce(v.id, 3) AS id FROM toks LEFT JOIN vocab v USING (symbol)
       UNION ALL SELECT lang, doc_id, line_no, CAST(len(t) AS BIGINT) AS pos, 2 AS id FROM tl),
ls AS (SELECT lang, doc_id, line_no, len(t) + 1 AS size,
              sum(len(t) + 1) OVER (PARTITION BY lang ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING) - (len(t) + 1) AS start
       FROM tl),
sp AS (SELECT tv.lang, ls.start + tv.pos AS spos, tv.id FROM tv JOIN ls USING (lang, doc_id, line_no)),
bl AS (SELECT lang, CAST(spos // 1024 AS BIGINT) AS block_id, CAST(min(spos) AS BIGINT) AS start_pos,
              CAST(max(spos) + 1 AS BIGINT) AS end_pos,
              string_agg(CAST(id AS VARCHAR), ' ' ORDER BY spos) AS ids, arg_max(id, spos) AS last_id
       FROM sp GROUP BY ALL)"""

ORACLE["win_06_token_blocks_none"] = f"WITH {STREAM_TOKENS} SELECT lang, block_id, start_pos, end_pos, md5(ids) AS ids_md5 FROM bl"

ORACLE["win_09_lm_shift"] = f"""WITH {STREAM_TOKENS},
lastb AS (SELECT lang, arg_max(last_id, block_id) AS stream_last FROM bl GROUP BY lang)
SELECT b.lang, b.block_id,
  md5(CAST(CASE WHEN b.block_id = 0 THEN l.stream_last ELSE p.last_id END AS VARCHAR) ||
      CASE WHEN strpos(b.ids, ' ') > 0 THEN ' ' || regexp_replace(b.ids, ' [^ ]*$', '') ELSE '' END) AS source_md5,
  md5(b.ids) AS target_md5
FROM bl b LEFT JOIN bl p ON p.lang = b.lang AND p.block_id = b.block_id - 1 JOIN lastb l ON l.lang = b.lang"""

ORACLE["win_08_token_blocks_eos"] = f"""WITH {DOC_LANG}
SELECT lang, doc_id, line_no, CAST(len(t) + 1 AS BIGINT) AS size FROM tl WHERE len(t) + 1 > 1"""

ORACLE["win_07_token_blocks_complete"] = f"""WITH RECURSIVE {DOC_LANG},
s AS (SELECT lang, doc_id, line_no, len(t) + 1 AS size,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) - 1 AS sn FROM tl),
ch AS (
  SELECT lang, sn, size AS cur, CAST(0 AS BIGINT) AS block_id FROM s WHERE sn = 0
  UNION ALL
  SELECT s.lang, s.sn,
         CASE WHEN ch.cur + s.size <= 1024 THEN ch.cur + s.size ELSE s.size END,
         CASE WHEN ch.cur + s.size <= 1024 THEN ch.block_id ELSE ch.block_id + 1 END
  FROM ch JOIN s ON s.lang = ch.lang AND s.sn = ch.sn + 1)
SELECT s.lang, ch.block_id, count(*) AS n_sentences, CAST(sum(s.size) AS BIGINT) AS n_tokens,
       arg_min(s.doc_id, s.sn) AS first_doc, arg_min(s.line_no, s.sn) AS first_line
FROM s JOIN ch USING (lang, sn) GROUP BY s.lang, ch.block_id"""

ORACLE["prj_17_first_n_words"] = f"""SELECT doc_id, CAST(len(t[1:1000]) AS BIGINT) AS n_words, md5(array_to_string(t[1:1000], ' ')) AS words_md5
FROM (SELECT doc_id, {tok('text')} AS t FROM documents)"""


# ---------------------------------------------------------------- scoring / losses
def scored_ctes(with_lang: bool = False, k: float = 1.0) -> str:
    lang = ", lang" if with_lang else ""
    return f"""{DOC_LANG}, {vocab_ctes(2, 30000)},
V AS (SELECT count(*) AS v FROM vocab),
tv AS (SELECT doc_id, line_no{lang}, pos, coalesce(v.id, 3) AS token FROM toks LEFT JOIN vocab v USING (symbol)
       UNION ALL SELECT doc_id, line_no{lang}, CAST(len(t) AS BIGINT) AS pos, 2 AS token FROM tl),
pos AS (SELECT doc_id, line_no{lang}, pos, token,
               coalesce(lag(token) OVER (PARTITION BY doc_id, line_no ORDER BY pos), 2) AS ctx FROM tv),
{model_ctes(k)},
scored AS (SELECT p.*, coalesce(m.lp, u.lp0) AS lp FROM pos p LEFT JOIN model m USING (ctx, token) LEFT JOIN unseen u USING (ctx))"""


def model_ctes(k: float, p: str = "", src: str = "pos") -> str:
    return f"""{p}pairs AS (SELECT ctx, token, count(*) AS c FROM {src} GROUP BY ALL),
{p}cx AS (SELECT ctx, sum(c) AS t, count(*) AS n_seen FROM {p}pairs GROUP BY ctx),
{p}model AS (SELECT ctx, token, ln((c + {k}) / (t + {k} * (SELECT v FROM V))) AS lp FROM {p}pairs JOIN {p}cx USING (ctx)),
{p}unseen AS (SELECT ctx, ln({k} / (t + {k} * (SELECT v FROM V))) AS lp0, n_seen FROM {p}cx)"""


ORACLE["jn_09_label_gather"] = f"WITH {scored_ctes()} SELECT doc_id, line_no, CAST(pos AS INTEGER) AS pos, CAST(token AS INTEGER) AS token, round(lp, 6) AS lp FROM scored"
ORACLE["agg_14_sequence_score"] = f"""WITH {scored_ctes()}
SELECT doc_id, line_no, round(sum(lp) / count(*), 6) AS score, count(*) AS length FROM scored GROUP BY ALL"""
ORACLE["win_03_nbest"] = f"""WITH {scored_ctes()},
sc AS (SELECT doc_id, line_no, round(sum(lp) / count(*), 6) AS score FROM scored GROUP BY ALL),
rk AS (SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS INTEGER) AS rank, score FROM sc)
SELECT * FROM rk WHERE rank <= 2"""
ORACLE["agg_15_lm_perplexity"] = f"""WITH {scored_ctes(True)}
SELECT lang, count(*) AS count, round(-sum(lp) / count(*), 6) AS nll, round(exp(-sum(lp) / count(*)), 4) AS ppl
FROM scored WHERE lp <> 'inf'::DOUBLE AND lp <> '-inf'::DOUBLE GROUP BY lang"""
ORACLE["agg_16_nll_loss"] = f"""WITH {scored_ctes(True)}
SELECT lang, round(-sum(lp), 4) AS loss, count(*) AS ntokens, round(-sum(lp) / count(*) / ln(2), 6) AS bits
FROM scored WHERE token <> 1 GROUP BY lang"""
ORACLE["agg_17_label_smoothed_loss"] = f"""WITH {scored_ctes(True)},
cs AS (SELECT ctx, -sum(lp) AS obs FROM model GROUP BY ctx),
sm AS (SELECT ctx, obs - ((SELECT v FROM V) - n_seen) * lp0 AS smooth FROM cs JOIN unseen USING (ctx)),
per AS (SELECT lang, -lp AS nll, 0.9 * (-lp) + 0.1 / (SELECT v FROM V) * smooth AS loss
        FROM scored LEFT JOIN sm USING (ctx) WHERE token <> 1)
SELECT lang, round(sum(loss) / count(*) / ln(2), 6) AS loss_bits, round(sum(nll) / count(*) / ln(2), 6) AS nll_bits,
       count(*) AS ntokens FROM per GROUP BY lang"""
ORACLE["agg_18_token_accuracy"] = f"""WITH {scored_ctes(True)},
am AS (SELECT ctx, arg_max(token, (lp, -token)) AS pred FROM model GROUP BY ctx)
SELECT lang, CAST(sum(CASE WHEN pred = token THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS ntokens,
       round(sum(CASE WHEN pred = token THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS accuracy
FROM scored LEFT JOIN am USING (ctx) GROUP BY lang"""
ORACLE["agg_21_banded_loss"] = f"""WITH {scored_ctes()},
b AS (SELECT lp,
  CASE WHEN token < 1000 THEN 0 WHEN token < 10000 THEN 1 ELSE 2 END AS band,
  CASE WHEN token < 1000 THEN token WHEN token < 10000 THEN 999 ELSE 1000 END AS head,
  CASE WHEN token < 1000 THEN NULL WHEN token < 10000 THEN token - 1000 ELSE token - 10000 END AS tail FROM scored)
SELECT CAST(band AS INTEGER) AS band, round(-sum(lp), 4) AS loss, count(*) AS ntokens,
       CAST(min(head) AS INTEGER) AS min_head, CAST(max(tail) AS INTEGER) AS max_tail FROM b GROUP BY band"""
ORACLE["agg_19_kl_teaching_loss"] = f"""WITH {scored_ctes()}, {model_ctes(0.5, 't_')},
both_ AS (SELECT coalesce(t.ctx, s.ctx) AS ctx, t.lp AS tlp, s.lp AS slp
          FROM t_model t FULL OUTER JOIN model s ON s.ctx = t.ctx AND s.token = t.token),
j AS (SELECT b.ctx, coalesce(tlp, tu.lp0) AS tl, coalesce(slp, su.lp0) AS sl, tu.lp0 AS t0, su.lp0 AS s0
      FROM both_ b JOIN t_unseen tu USING (ctx) JOIN unseen su USING (ctx)),
o AS (SELECT ctx, sum(CASE WHEN exp(tl) > 0 THEN exp(tl) * (tl - sl) ELSE 0 END) AS obs, count(*) AS n,
             first(t0) AS t0, first(s0) AS s0 FROM j GROUP BY ctx)
SELECT CAST(ctx AS INTEGER) AS ctx,
       round(obs + ((SELECT v FROM V) - n) * CASE WHEN exp(t0) > 0 THEN exp(t0) * (t0 - s0) ELSE 0 END, 6) AS kl FROM o"""
ORACLE["agg_27_ensemble_average"] = f"""WITH {scored_ctes()}, {model_ctes(0.5, 'a_')}, {model_ctes(2.0, 'b_')},
u AS (SELECT ctx, token, lp FROM a_model UNION ALL SELECT ctx, token, lp FROM model UNION ALL SELECT ctx, token, lp FROM b_model)
SELECT CAST(ctx AS INTEGER) AS ctx, CAST(token AS INTEGER) AS token, round(ln(sum(exp(lp)) / 3), 6) AS lp FROM u GROUP BY ALL"""
ORACLE["win_02_cumulative_to_positional"] = f"""WITH {scored_ctes()}
SELECT doc_id, line_no, CAST(pos AS INTEGER) AS pos, round(lp, 6) AS positional FROM scored"""


# ---------------------------------------------------------------- attention tables
def attention_cte(name: str, width: int) -> str:
    return f"""{name}_t AS (SELECT conv_id, turn, src_len, tgt_len, unnest(generate_series(0, tgt_len - 1)) AS tgt_pos FROM plen),
{name}_c AS (SELECT *, least(CAST(round(tgt_pos * src_len / tgt_len) AS INTEGER), src_len - 1) AS c FROM {name}_t),
{name}_s AS (SELECT conv_id, turn, tgt_pos, c, unnest(generate_series(greatest(c - {width}, 0), least(c + {width}, src_len - 1))) AS src_pos FROM {name}_c),
{name} AS (SELECT conv_id, turn, CAST(tgt_pos AS INTEGER) AS tgt_pos, CAST(src_pos AS INTEGER) AS src_pos,
  ({width} + 1 - abs(src_pos - c)) / sum({width} + 1 - abs(src_pos - c)) OVER (PARTITION BY conv_id, turn, tgt_pos) AS weight FROM {name}_s)"""


ORACLE["win_04_topk_positions"] = f"""WITH {PLEN}, {attention_cte('att', 2)},
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, tgt_pos ORDER BY weight DESC, src_pos) AS rk FROM att)
SELECT conv_id, turn, count(*) AS n, CAST(sum(src_pos) AS BIGINT) AS sum_src FROM r WHERE rk <= 3 GROUP BY ALL"""
ORACLE["win_05_hard_alignment"] = f"""WITH {PLEN}, {attention_cte('att', 2)}
SELECT conv_id, turn, tgt_pos, arg_max(src_pos, (weight, -src_pos)) AS src_pos FROM att GROUP BY ALL"""
RELAY = f"""{PLEN}, {attention_cte('a2', 2)}, {attention_cte('a1', 1)},
top AS (SELECT conv_id, turn, tgt_pos, src_pos AS pivot_pos FROM (
          SELECT *, row_number() OVER (PARTITION BY conv_id, turn, tgt_pos ORDER BY weight DESC, src_pos) AS rk FROM a2) WHERE rk <= 3),
hard AS (SELECT conv_id, turn, tgt_pos AS pivot_pos, arg_max(src_pos, (weight, -src_pos)) AS src_pos FROM a1 GROUP BY ALL),
relay AS (SELECT DISTINCT t.conv_id, t.turn, t.tgt_pos, h.src_pos FROM top t JOIN hard h USING (conv_id, turn, pivot_pos))"""
ORACLE["jn_10_attention_relay"] = f"""WITH {RELAY}
SELECT conv_id, turn, count(*) AS n_cells, CAST(sum(src_pos) AS BIGINT) AS sum_src FROM relay GROUP BY ALL"""
ORACLE["agg_20_attention_teaching_loss"] = f"""WITH {RELAY},
j AS (SELECT coalesce(s.weight, 0) - coalesce(CASE WHEN r.conv_id IS NOT NULL THEN 0.3 END, 0) AS d
      FROM a2 s FULL OUTER JOIN relay r ON r.conv_id = s.conv_id AND r.turn = s.turn AND r.tgt_pos = s.tgt_pos AND r.src_pos = s.src_pos)
SELECT round(sqrt(sum(d * d)), 6) AS loss FROM j"""
ORACLE["agg_28_head_average_attention"] = f"""WITH {PLEN}, {attention_cte('h0', 1)}, {attention_cte('h1', 3)},
u AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1),
avg_ AS (SELECT conv_id, turn, tgt_pos, src_pos, sum(weight) / 2 AS weight FROM u GROUP BY ALL)
SELECT conv_id, turn, count(*) AS n_cells, round(sum(weight), 6) AS total FROM avg_ GROUP BY ALL"""


# ---------------------------------------------------------------- checkpoints, meters
ORACLE["win_13_last_n_checkpoints"] = """SELECT 'checkpoint' || vec_id || '.pt' AS name, vec_id AS epoch FROM embeddings
WHERE vec_id <= 400 ORDER BY vec_id DESC LIMIT 5"""
ORACLE["win_14_prune_old_checkpoints"] = """SELECT 'checkpoint' || vec_id || '.pt' AS name, vec_id AS epoch FROM embeddings
WHERE vec_id NOT IN (SELECT vec_id FROM embeddings ORDER BY vec_id DESC LIMIT 10)"""
ORACLE["agg_23_weighted_average_meter"] = """SELECT event_type, round(sum(value * (user_id % 5 + 1)) / sum(user_id % 5 + 1), 6) AS avg,
  arg_max(value, ts) AS last, CAST(sum(user_id % 5 + 1) AS BIGINT) AS count FROM events GROUP BY event_type"""
ORACLE["agg_24_rate_meter"] = """SELECT event_type, count(*) AS n,
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS rate FROM events GROUP BY event_type"""
ORACLE["agg_22_aggregate_logs"] = """WITH o AS (SELECT floor(epoch(ts) / 600) AS upd, value AS loss, value / 2 AS nll_loss,
    user_id % 7 + 1 AS ntokens FROM events)
SELECT CAST(upd AS BIGINT) AS update, round(sum(loss), 6) AS loss, CAST(sum(ntokens) AS BIGINT) AS ntokens,
  round(sum(loss) / sum(ntokens) / ln(2), 6) AS loss_bits, round(sum(nll_loss) / sum(ntokens) / ln(2), 6) AS nll_bits
FROM o GROUP BY upd"""
ORACLE["src_05_infer_language_pair"] = """SELECT split_part(name, '.', 2)[1:position('-' IN split_part(name, '.', 2)) - 1] AS src,
  split_part(split_part(name, '.', 2), '-', 2) AS tgt
FROM (SELECT DISTINCT 'train.' || lang || '-en.bin' AS name FROM documents) ORDER BY name LIMIT 1"""
ORACLE["agg_26_check_same_keys"] = """SELECT label AS run, true AS same_keys, count(*) AS n_checkpoints FROM embeddings GROUP BY label"""


# ---------------------------------------------------------------- streaming (same results as batch)
ORACLE["str_02_stream_word_counts"] = f"""WITH {DOC}
SELECT symbol, count(*) AS count FROM toks GROUP BY symbol"""
# append mode emits a window once the watermark (max event time - 10 minutes) has passed its end
ORACLE["str_03_stream_meters"] = """SELECT * FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total
  FROM events GROUP BY 1, 2)
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
ORACLE["str_04_stream_score"] = ORACLE["agg_05_encode_stats"].replace(
    "SELECT ls.lang, nseq, ntok, CAST(coalesce(nunk, 0) AS BIGINT) AS nunk,",
    "SELECT ls.lang, CAST(nseq AS BIGINT) AS nseq, CAST(ntok AS BIGINT) AS ntok, CAST(coalesce(nunk, 0) AS BIGINT) AS nunk, --").replace(
    "       CAST(coalesce(replaced, 0) AS BIGINT) AS replaced,\n       round(100.0::DOUBLE * coalesce(nunk, 0) / ntok, 6) AS pct_replaced\n", "\n")
ORACLE["str_01_stream_encode"] = ORACLE["jn_01_encode"].replace(
    "SELECT doc_id, line_no, CAST(coalesce(e.n, 0) + 1 AS BIGINT) AS n_ids, coalesce(e.s || ' 2', '2') AS ids",
    "SELECT doc_id, line_no, CAST(coalesce(e.n, 0) + 1 AS BIGINT) AS n_ids, md5(coalesce(e.s || ' 2', '2')) AS ids_md5")


# ---------------------------------------------------------------- text functions
ORACLE["prj_14_lowercase"] = f"WITH {lines_cte('')} SELECT doc_id, line_no, md5(lower(text)) AS text_md5 FROM lines"
ORACLE["prj_15_mask_digits"] = f"""WITH {lines_cte('')}
SELECT doc_id, line_no, regexp_replace(text, '[0-9]', '#', 'g') AS masked FROM lines WHERE regexp_matches(text, '[0-9]')"""
ORACLE["prj_16_unk_to_UNK"] = _decode_sql("<unk>").replace(
    "SELECT doc_id, line_no, coalesce(e.s, '') AS text FROM tl",
    "SELECT doc_id, line_no, CAST(len(string_split(replace(coalesce(e.s, ''), '<unk>', 'UNK'), 'UNK')) - 1 AS BIGINT) AS n_unk FROM tl")
ORACLE["prj_07_remove_bpe"] = f"""WITH {DOC},
r AS (SELECT doc_id, line_no, array_to_string(t, ' ') AS orig,
  rtrim(replace(array_to_string(list_transform(t, lambda w: CASE WHEN length(w) > 4 THEN substring(w, 1, 4) || '@@ ' || substring(w, 5) ELSE w END), ' ') || ' ', '@@ ', ''), ' ') AS restored
  FROM tl)
SELECT doc_id, line_no, restored = orig AS round_trip, md5(restored) AS text_md5 FROM r"""

ORACLE["set_01_concat_datasets"] = f"""WITH {lines_cte('')},
u AS (SELECT 0 AS corpus_ord, doc_id AS k1, line_no AS k2 FROM lines
      UNION ALL SELECT 1 AS corpus_ord, conv_id AS k1, turn AS k2 FROM conversations)
SELECT corpus_ord, k1, k2, row_number() OVER (ORDER BY corpus_ord, k1, k2) - 1 AS id FROM u"""


# ---------------------------------------------------------------- alignments over the joint vocabulary
JOINT = f"""{PAIRS_CTE},
sides AS (SELECT 0 AS side, conv_id, turn, src_text AS text FROM pairs
          UNION ALL SELECT 1 AS side, conv_id, turn, tgt_text AS text FROM pairs),
jtl AS (SELECT side, conv_id, turn, list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '') AS t FROM sides),
jtoks AS (SELECT side, conv_id, turn, CAST(unnest(generate_series(0, len(t) - 1)) AS BIGINT) AS pos, unnest(t) AS symbol
          FROM jtl WHERE len(t) > 0),
{vocab_ctes(2, 8000, toks='jtoks', nlines='jtl', order='side, conv_id, turn', p='j_')}"""
LINKS = f"""{JOINT},
ids AS MATERIALIZED (SELECT side, conv_id, turn, pos, symbol, coalesce(v.id, 3) AS id FROM jtoks LEFT JOIN j_vocab v USING (symbol)),
src_ids AS (SELECT conv_id, turn, pos, id FROM ids WHERE side = 0),
tgt_ids AS (SELECT conv_id, turn, pos, id FROM ids WHERE side = 1),
links AS MATERIALIZED (SELECT s.conv_id, s.turn, s.pos, s.id AS src_id, t.id AS tgt_id FROM src_ids s JOIN tgt_ids t USING (conv_id, turn, pos)),
npair AS (SELECT p.conv_id, p.turn, count(l.pos) AS n FROM pairs p LEFT JOIN links l ON l.conv_id = p.conv_id AND l.turn = p.turn GROUP BY ALL),
cooc AS (SELECT src_id, tgt_id, count(*) AS cnt, min(struct_pack(a := conv_id, b := turn, c := pos)) AS first
         FROM links WHERE src_id <> 3 AND tgt_id <> 3 GROUP BY ALL),
lexicon AS (SELECT src_id, tgt_id, cnt FROM cooc QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY cnt DESC, first) = 1)"""

ORACLE["src_12_read_alignments"] = f"WITH {LINKS} SELECT conv_id, turn, n AS n_links, CAST(n - 1 AS INTEGER) AS last_src FROM npair"
ORACLE["jn_04_alignment_tokens"] = f"""WITH {LINKS}
SELECT conv_id, turn, CAST(pos AS INTEGER) AS link_no, src_id, tgt_id FROM links"""
ORACLE["flt_08_known_pairs_only"] = f"""WITH {LINKS}
SELECT conv_id, turn, count(*) AS n_known FROM links WHERE src_id <> 3 AND tgt_id <> 3 GROUP BY ALL"""
ORACLE["agg_06_cooccurrence"] = f"WITH {LINKS} SELECT src_id, tgt_id, cnt FROM cooc"
ORACLE["agg_07_argmax_lexicon"] = f"WITH {LINKS} SELECT src_id, tgt_id, cnt FROM lexicon"
ORACLE["src_13_read_lexicon"] = f"""WITH {LINKS}
SELECT s.symbol AS src, t.symbol AS tgt FROM lexicon JOIN j_vocab s ON s.id = src_id JOIN j_vocab t ON t.id = tgt_id"""
ORACLE["agg_32_symmetrize"] = f"""WITH {LINKS}, n AS (
  SELECT p.conv_id, p.turn, p.n, (SELECT count(*) FROM ids i WHERE i.side = 0 AND i.conv_id = p.conv_id AND i.turn = p.turn) AS ns FROM npair p)
SELECT conv_id, turn, CAST(0 AS BIGINT) AS n_inter, CAST(n + CASE WHEN n > 0 THEN least(n, ns - 1) ELSE 0 END AS BIGINT) AS n_union FROM n"""
ORACLE["jn_05_replace_unk"] = f"""WITH {LINKS},
words AS (SELECT s.symbol AS src, t.symbol AS tgt FROM lexicon JOIN j_vocab s ON s.id = src_id JOIN j_vocab t ON t.id = tgt_id),
ns AS (SELECT conv_id, turn, len(t) AS n FROM jtl WHERE side = 0),
tgt AS (SELECT i.conv_id, i.turn, i.pos, i.id, i.symbol, CASE WHEN i.pos < ns.n THEN s.symbol ELSE '<eos>' END AS sw
        FROM ids i JOIN ns USING (conv_id, turn) LEFT JOIN ids s ON s.side = 0 AND s.conv_id = i.conv_id AND s.turn = i.turn AND s.pos = i.pos
        WHERE i.side = 1),
made AS (SELECT conv_id, turn, string_agg(CASE WHEN id = 3 THEN coalesce(w.tgt, sw) ELSE symbol END, ' ' ORDER BY pos) AS text,
                count(*) FILTER (id = 3) AS n FROM tgt LEFT JOIN words w ON tgt.id = 3 AND w.src = tgt.sw GROUP BY conv_id, turn)
SELECT p.conv_id, p.turn, md5(coalesce(text, '')) AS text_md5, CAST(coalesce(n, 0) AS BIGINT) AS n_replaced
FROM pairs p LEFT JOIN made m ON m.conv_id = p.conv_id AND m.turn = p.turn"""

# ---------------------------------------------------------------- embeddings, vocabulary and tagged files
EMB = f"""{DOC}, {vocab_ctes(2, 30000)},
emb AS (SELECT v.symbol, e.embedding AS vector FROM embeddings e JOIN vocab v ON v.id = e.vec_id WHERE NOT contains(v.symbol, ' '))"""
ORACLE["src_07_write_read_vocab"] = f"""WITH {DOC}, {vocab_ctes(2, 30000)}
SELECT id, symbol, CASE WHEN id < 4 THEN 1 ELSE count END AS count FROM vocab"""
ORACLE["src_11_read_embeddings"] = f"""WITH {EMB}
SELECT symbol, CAST(len(vector) AS BIGINT) AS dim,
       round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE))), 3) + 0.0 AS vsum FROM emb"""
ORACLE["jn_06_embedding_vocab_join"] = f"""WITH {EMB}, {JOINT}
SELECT v.id, v.symbol, e.symbol IS NOT NULL AS pretrained, CAST(coalesce(len(e.vector), 64) AS BIGINT) AS dim,
       round(coalesce(CAST(e.vector[1] AS DOUBLE), 0.0), 5) AS v0 FROM j_vocab v LEFT JOIN emb e ON e.symbol = v.symbol"""
ORACLE["jn_07_embedding_overlap"] = f"""WITH {EMB}, {JOINT}, n AS (
  SELECT count(*) FILTER (symbol IN (SELECT symbol FROM emb)) AS n_found, count(*) AS n_vocab FROM j_vocab)
SELECT n_found, n_vocab, CAST(n_found AS DOUBLE) / n_vocab AS overlap FROM n"""
ORACLE["set_03_embedding_vocab_intersect"] = f"WITH {EMB}, {JOINT} SELECT symbol FROM j_vocab INTERSECT SELECT symbol FROM emb"
ORACLE["src_17_read_tagged_text"] = r"""WITH parts AS (
  SELECT page_id, string_split_regex(replace(html, '<', chr(1) || '<'), '\r\n|\r|\n|\x01') AS p, starts_with(html, '<') AS lead FROM pages),
kept AS (SELECT page_id, list_transform(list_filter(CASE WHEN lead THEN p[2:] ELSE p END, lambda x: NOT regexp_matches(x, '<url>|<talkid>|<keywords>')),
                                        lambda x: regexp_replace(x, '</?(title|description)>', '', 'g')) AS t FROM parts)
SELECT page_id, CAST(len(t) AS BIGINT) AS n_lines, md5(array_to_string(t, chr(10))) AS text_md5 FROM kept WHERE len(t) > 0"""
ORACLE["src_18_read_sgm_segments"] = r"""WITH t AS (SELECT page_id, regexp_extract(html, '(<title>.*?</title>)', 1) AS text FROM pages)
SELECT page_id, replace(regexp_replace(regexp_replace(text, '<title[^>]*>\s*', '', 'g'), '\s*</title>\s*', '', 'g'), '’', chr(39)) AS text
FROM t WHERE contains(text, '<title')"""
ORACLE["agg_25_average_checkpoints"] = """WITH e AS (SELECT label AS run, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
c AS (SELECT run, 'emb' AS param, CAST(v AS DOUBLE) AS v, pos FROM e
      UNION ALL SELECT run, 'emb_int', CAST(trunc(v * CAST(100 AS FLOAT)) AS DOUBLE), pos FROM e),
m AS (SELECT run, param, pos, CASE WHEN param = 'emb_int' THEN trunc(avg(v)) ELSE avg(v) END AS m FROM c GROUP BY run, param, pos)
SELECT run, param, count(*) AS dim, round(sum(m), 4) + 0.0 AS vsum, round(max(m) FILTER (pos = 1), 6) + 0.0 AS v0 FROM m GROUP BY run, param"""
