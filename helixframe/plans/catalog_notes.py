"""Queries of the notes index: documents as notes, changed in three batches; the SQL twin stems words by nested queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import notes
from helixframe.plans.catalog import c, plan

_V, _C = "[aeiouy]", "[^aeiouy]"
_OVER0, _OVER1, _IS1 = f"^{_C}*{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}*$"
_SHORT = f"{_C}{_V}[^aeiouywxY]$"


def _like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _cut(word: str, n: str) -> str:
    return f"left({word}, length({word}) - {n})"


def _end(word: str, options) -> str:
    return f"regexp_extract({word}, '({'|'.join(options)})$', 1)"


def _swap(end: str, table: dict[str, str]) -> str:
    return f"CASE {end} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " ELSE '' END"


#: The columns of each nested query, from the word to w8.
_LAYERS = [
    {"w0": f"regexp_replace(word, '(^|{_V})y', '\\1Y', 'g')"},
    {"s1": _end("w0", ("sses", "ies", "ss", "s"))},
    {"w1": f"{_cut('w0', 'length(s1)')} || CASE s1 WHEN 'sses' THEN 'ss' WHEN 'ies' THEN 'i' WHEN 'ss' THEN 'ss' ELSE '' END"},
    {"s2": _end("w1", ("eed", "ed", "ing"))},
    {"t2": _cut("w1", "length(s2)")},
    {"w2": f"CASE WHEN s2 = '' THEN w1 WHEN s2 = 'eed' THEN CASE WHEN {_like('t2', _OVER0)} THEN t2 || 'ee' ELSE w1 END WHEN NOT {_like('t2', _V)} THEN w1 WHEN {_like('t2', '(at|bl|iz)$')} THEN t2 || 'e'"
           f" WHEN right(t2, 1) = right(left(t2, length(t2) - 1), 1) AND {_like('t2', '[^aeiouylsz]$')} THEN {_cut('t2', '1')} WHEN {_like('t2', _IS1)} AND {_like('t2', _SHORT)} THEN t2 || 'e' ELSE t2 END"},
    {"w3": f"CASE WHEN {_like('w2', '[yY]$')} AND {_like(_cut('w2', '1'), _V)} THEN {_cut('w2', '1')} || 'i' ELSE w2 END"},
    {"s4": _end("w3", notes.STEP2)},
    {"w4": f"CASE WHEN s4 <> '' AND {_like(_cut('w3', 'length(s4)'), _OVER0)} THEN {_cut('w3', 'length(s4)')} || {_swap('s4', notes.STEP2)} ELSE w3 END"},
    {"s5": _end("w4", notes.STEP3)},
    {"w5": f"CASE WHEN s5 <> '' AND {_like(_cut('w4', 'length(s5)'), _OVER0)} THEN {_cut('w4', 'length(s5)')} || {_swap('s5', notes.STEP3)} ELSE w4 END"},
    {"s6": _end("w5", notes.STEP4)},
    {"t6": _cut("w5", "length(s6)")},
    {"w6": f"CASE WHEN s6 <> '' AND {_like('t6', _OVER1)} AND (s6 <> 'ion' OR {_like('t6', '[st]$')}) THEN t6 ELSE w5 END"},
    {"t7": _cut("w6", "1")},
    {"w7": f"CASE WHEN {_like('w6', 'e$')} AND ({_like('t7', _OVER1)} OR ({_like('t7', _IS1)} AND NOT {_like('t7', _SHORT)})) THEN t7 ELSE w6 END"},
    {"w8": f"CASE WHEN {_like('w7', 'll$')} AND {_like('w7', _OVER1)} THEN {_cut('w7', '1')} ELSE w7 END"},
]
_STEM = "SELECT DISTINCT word FROM w"
for _layer in _LAYERS:
    _STEM = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in _layer.items())} FROM ({_STEM})"
_WORDS = "regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}]+)', 1)"
_UPDATE = " Running notes, relationally updated"

INDEX = f"""WITH live AS (SELECT doc_id AS id, {_WORDS.format("text || CASE WHEN doc_id % 5 = 0 THEN '" + _UPDATE + "' ELSE '' END")} AS ws FROM documents WHERE doc_id % 7 <> 0),
 a AS (SELECT doc_id AS query_id, list_slice({_WORDS.format('text')}, 2, 3) AS ws FROM documents WHERE doc_id % 50 = 0),
 w AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS position FROM live), aw AS (SELECT query_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS position FROM a),
 st AS MATERIALIZED (SELECT word, CASE WHEN regexp_full_match(word, '[a-z][a-z][a-z]+') THEN lower(w8) ELSE word END AS term FROM ({_STEM.replace('FROM w)', 'FROM (SELECT word FROM w UNION ALL SELECT word FROM aw))')})),
 tok AS (SELECT term, id, CAST(position AS INT) AS position FROM w JOIN st ON st.word = w.word), q AS (SELECT query_id, term, CAST(position AS INT) AS position FROM aw JOIN st ON st.word = aw.word),
 sizes AS (SELECT id, len(ws) AS size FROM live), tot AS (SELECT count(*) AS n, sum(size) AS s FROM sizes),
 post AS (SELECT term, id, count(*) AS n, list_sort(list(position)) AS positions FROM tok GROUP BY 1, 2)"""
_RANK = """, df AS (SELECT unit, count(DISTINCT id) AS df FROM f GROUP BY 1),
 m AS (SELECT query_id, id, count(*) AS met, units, CAST(sum(tf) AS BIGINT) AS hits, -sum(greatest(CASE WHEN (tot.n - df + 0.5) / (df + 0.5) > 1 THEN ln((tot.n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size * tot.n / tot.s))) AS sc FROM f JOIN df ON df.unit = f.unit JOIN sizes USING (id), tot GROUP BY query_id, id, units)
 SELECT * EXCLUDE (sc), round(sc, 6) AS score FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9), id) AS INT) AS rank, id, hits, sc FROM m WHERE met = units) WHERE rank <= 10"""


def index_of(t) -> notes.Index:
    """All documents put in, then a fifth of them updated, then a seventh deleted: three segments, merged."""
    d = t("documents").select(c("doc_id").alias("id"), "text")
    batch = lambda rows, seq, op, text: notes.build(rows.select("id", F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), text.alias("text")))
    put, newer = batch(d, 1, "insert", c("text")), batch(d.filter("id % 5 = 0"), 2, "update", F.concat("text", F.lit(_UPDATE)))
    return notes.merge(put, newer, batch(d.filter("id % 7 = 0"), 3, "delete", F.lit(None).cast("string")))


def asked(t) -> DataFrame:
    """The second and third words of every fiftieth document, as a query."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(notes.TOKEN), 1)
    return t("documents").filter("doc_id % 50 = 0").select(c("doc_id").alias("query_id"), F.array_join(F.slice(words, 2, 2), " ").alias("text"))


plan("V09i", INDEX + " SELECT * FROM post")(lambda t: index_of(t).postings.select("term", "id", "n", "positions"))
plan("V09s", INDEX + ", qs AS (SELECT DISTINCT query_id, term FROM q), f AS (SELECT qs.query_id, qs.term AS unit, u.units, id, n AS tf FROM qs JOIN (SELECT query_id, count(*) AS units FROM qs GROUP BY 1) u ON u.query_id = qs.query_id JOIN post ON post.term = qs.term)" + _RANK)(
    lambda t: notes.search(index_of(t), asked(t)).withColumn("score", F.round("score", 6))
)
plan("V09p", INDEX + ", h AS (SELECT q.query_id, tok.id, tok.position - q.position AS start, count(*) AS held FROM q JOIN tok ON tok.term = q.term GROUP BY 1, 2, 3), f AS (SELECT h.query_id, h.query_id AS unit, 1 AS units, id, count(*) AS tf FROM h JOIN (SELECT query_id, count(*) AS length FROM q GROUP BY 1) l ON l.query_id = h.query_id WHERE held = length GROUP BY h.query_id, id)" + _RANK)(
    lambda t: notes.phrases(index_of(t), asked(t)).withColumn("score", F.round("score", 6))
)
