"""The catalogue's queries in SQL for a second engine.

That engine's regular expressions have no lookaround, so borders are matched as
groups, each rewrite applied twice where matches can touch.
"""

from __future__ import annotations

import re
from functools import reduce

from gleaner.functions import text as T
from gleaner.operators import dense
from gleaner.plans import prompts
from gleaner.plans.catalogue import MARKS

GAP = r"[\s\p{Z}\x{200B}]"
WS = r"[\s\p{Z}]"
W = r"[\p{L}\p{N}_]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"^{WS}+|{WS}+$", "")


def spaces(x: str) -> str:
    return strip(sub(sub(f"replace({x}, chr(160), ' ')", r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def folded(x: str) -> str:
    return f"translate(replace(lower({x}), 'ß', 'ss'), 'ςſµ', 'σsμ')"


def matched(x: str, keep: bool = True) -> str:
    low = folded(spaces(x))
    return strip(sub(low if keep else f"strip_accents({low})", f"{GAP}+", " "))


def ocr(x: str) -> str:
    for pattern, to in ((r"(\p{Nd})[lI](\p{Nd})", r"\g1\2"), (r"(\p{Nd})[oO](\p{Nd})", r"\g0\2")):
        to = to.replace("\\g1", "\\1" + "1").replace("\\g0", "\\1" + "0")
        x = sub(sub(x, pattern, to), pattern, to)
    x = sub(x, rf"(^|[^\p{{L}}\p{{N}}_])rn({W})", r"\1m\2")
    x = sub(x, rf"{WS}+([,.;:!?])", r"\1")
    x = sub(x, r"([,.;:!?])([^\s\p{Z}])", r"\1 \2")
    return spaces(sub(x, rf"{WS}{{2,}}", " "))


def clean(x: str) -> str:
    return strip(ocr(spaces(f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")))


def expanded(x: str) -> str:
    out = f"(' ' || {x} || ' ')"
    for short, full in T.ABBREVIATIONS:
        for _ in range(2):
            out = sub(out, rf"(?i)(^|[^\p{{L}}\p{{N}}_]){short}([^\p{{L}}\p{{N}}_]|$)", rf"\1{full}\2")
    return f"CASE WHEN {x} = '' THEN '' ELSE {spaces(out)} END"


def tokens(x: str, stop: bool = False, keep: bool = True) -> str:
    found = f"list_filter(regexp_extract_all({matched(x, keep)}, '{W}+'), lambda w: length(w) > 1)"
    return f"list_filter({found}, lambda w: w NOT IN ({', '.join(map(quoted, T.STOP_WORDS))}))" if stop else found


def terms(x: str) -> str:
    return tokens(x, True, False)


def sentences(x: str) -> str:
    hidden = reduce(lambda a, p: f"replace({a}, {quoted(p[0])}, {quoted(p[1])})", T.PROTECTED, spaces(x))
    parts = f"list_filter(list_transform(string_split(regexp_replace({hidden}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"
    return f"list_transform({parts}, lambda s: {reduce(lambda a, p: f'replace({a}, {quoted(p[1])}, {quoted(p[0])})', T.PROTECTED, 's')})"


def count_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(pattern)}))"


def token_count(x: str) -> str:
    marks = count_of(x, r"[.,;:!?()\[\]{}]")
    return f"CASE WHEN {x} = '' THEN 0 ELSE {count_of(x, W + '+')} + greatest(1, {marks} // 2) END::BIGINT"


def intent(x: str) -> str:
    return f"(SELECT CASE {' '.join(f'WHEN regexp_matches(mt, {quoted(f'(^|[^{W[1:-1]}])({p})([^{W[1:-1]}]|$)')}) THEN {quoted(label)}' for label, p in T.INTENTS)} ELSE 'general' END FROM (SELECT {matched(x, False)} AS mt))"


def any_of(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(p)})" for p in parts) + ")"


def heading(x: str) -> str:
    return f"regexp_matches({x}, {quoted('(?i)' + T.HEADING)})"


def hashes(x: str) -> str:
    return strip(f"regexp_replace({x}, '^#{{1,6}}\\s*', '')")


def summary(x: str, n: int) -> str:
    flat = strip(sub(x, WS + "+", " "))
    return f"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE {sub(f'{flat}[1:{n}]', WS + '+$', '')} || '...' END"


def on_documents(**columns: str) -> str:
    return "SELECT doc_id, " + ", ".join(f"{e} AS {name}" for name, e in columns.items()) + " FROM documents"


CHUNKS = "c AS (SELECT doc_id AS chunk_id, text AS content, lang AS subject, source AS parent_key, source || '_' || doc_id || '.txt' AS source_name FROM documents)"
TOKENS = f"t AS MATERIALIZED (SELECT doc_id AS chunk_id, {terms("concat_ws(' ', lang, source, nullif(text, ''))")} AS terms FROM documents)"
LENGTHS = "l AS (SELECT chunk_id, len(terms) AS length FROM t), st AS (SELECT count(*) AS n_docs, avg(length) AS mean_length FROM l)"
POSTINGS = "p AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM t) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term)"
QUESTIONS = f"q AS MATERIALIZED (SELECT item_id AS query_id, text, {terms('text')} AS terms FROM benchmark)"
INDEX = ",\n".join([TOKENS, LENGTHS, POSTINGS, QUESTIONS])
WEIGHT = "qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.4 / greatest(tf + 1.4 * (1 - 0.75 + 0.75 * length / greatest(mean_length, 1e-6)), 1e-6))"


def top(source: str, k: int, score: str = "score", by: str = "query_id") -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, chunk_id) <= {k}"


SPARSE = f"""qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY ALL),
sa AS (SELECT query_id, chunk_id, round(sum({WEIGHT}), 6) AS score FROM qt JOIN p USING (term) JOIN f USING (term) JOIN l USING (chunk_id), st GROUP BY ALL),
s AS MATERIALIZED ({top("(SELECT * FROM sa WHERE score > 0)", 48)})"""
DOT = "round(greatest(-1, least(1, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
DENSE = f"""da AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
d AS MATERIALIZED ({top("da", 48)})"""


def fuse(dense_cte: str = "d", sparse_cte: str = "s") -> str:
    rank = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)"
    return f"""fa AS (SELECT query_id, chunk_id, dr, sr, coalesce(ds, 0) AS dense_score, coalesce(ss, 0) AS sparse_score, ds, max(sr IS NOT NULL) OVER (PARTITION BY query_id) AS hybrid
  FROM (SELECT query_id, chunk_id, score AS ds, {rank} AS dr FROM {dense_cte}) FULL JOIN (SELECT query_id, chunk_id, score AS ss, {rank} AS sr FROM {sparse_cte}) USING (query_id, chunk_id)),
fb AS (SELECT query_id, chunk_id, dense_score, sparse_score, round(CASE WHEN hybrid THEN coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0) ELSE ds END, 9) AS rrf_score FROM fa),
fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM fb QUALIFY rank <= 96)"""


OVERLAP = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
SCORED = f"""ct AS MATERIALIZED (SELECT doc_id AS chunk_id, list_distinct({terms("text")}) AS own FROM documents WHERE doc_id IN (SELECT chunk_id FROM fused)),
na AS (SELECT *, dense_score / greatest(max(dense_score) OVER w, 1e-6) AS dense_norm, sparse_score / greatest(max(sparse_score) OVER w, 1e-6) AS sparse_norm, rrf_score / greatest(max(rrf_score) OVER w, 1e-6) AS rrf_norm FROM fused WINDOW w AS (PARTITION BY query_id)),
nb AS (SELECT na.*, {OVERLAP.format(a="list_distinct(q.terms)", b="own")} AS lexical_score FROM na JOIN ct USING (chunk_id) JOIN q USING (query_id)),
nc AS (SELECT *, 0.60 * dense_norm + 0.30 * sparse_norm + 0.10 * lexical_score AS rerank_score FROM nb WHERE NOT (dense_score < 0.30 AND sparse_score <= 0 AND lexical_score < 0.03)),
scored AS MATERIALIZED (SELECT nc.*, parent_key, content, subject, source_name, round(least(1, greatest(0, 0.42 * rerank_score + 0.30 * rrf_norm + 0.18 * dense_norm + 0.07 * sparse_norm + 0.03 * lexical_score)), 9) AS final_score FROM nc JOIN c USING (chunk_id))"""
CONTEXTS = """ca AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_key ORDER BY final_score DESC, chunk_id) > 1 AS later FROM scored),
ctx AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, final_score DESC, chunk_id) AS place FROM ca QUALIFY place <= 10)"""
HYBRID = ",\n".join([CHUNKS, INDEX, SPARSE, DENSE, fuse(), SCORED])
GATE = """ga AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS r, least(5, count(*) OVER (PARTITION BY query_id)) AS n FROM ctx),
gb AS (SELECT query_id, max(final_score) FILTER (r = 1) AS t1, max(final_score) FILTER (r = 2) AS t2, max(final_score) FILTER (r = n - n // 2) AS up, max(final_score) FILTER (r = n // 2 + 1) AS down, max(rerank_score) AS rerank FROM ga GROUP BY query_id),
gc AS (SELECT *, round(least(1, greatest(0, 0.55 * t1 + 0.25 * least(1, 1.8 * greatest(0, t1 - up)) + 0.20 * least(1, 2.2 * CASE WHEN t2 IS NULL THEN t1 ELSE greatest(0, t1 - t2) END))), 9) AS confidence FROM gb),
gate AS (SELECT item_id AS query_id, coalesce(confidence, 0) AS confidence, coalesce(confidence < 0.46 OR round(greatest(0, t1 - down), 9) < 0.06 OR round(greatest(0, t1 - coalesce(t2, 0)), 9) < 0.04 OR rerank < 0.34, true) AS needs_clarification
  FROM benchmark LEFT JOIN gc ON query_id = item_id)"""
BUDGET = f"""ba AS (SELECT * EXCLUDE (place), {token_count("content")} AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS place FROM ctx),
bb AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM ba),
bc AS (SELECT *, max((place > 6 AND held + tokens > 3000 AND held >= 1500)::INT) OVER (PARTITION BY query_id ORDER BY place) AS stop FROM bb),
budget AS MATERIALIZED (SELECT * FROM bc WHERE stop = 0 AND place <= 10)"""
EVIDENCE = f"""ea AS (SELECT query_id, place, final_score, source_name, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos FROM (SELECT *, {sentences("content")} AS ss FROM budget)),
eb AS (SELECT *, list_distinct({terms("sentence")}) AS own FROM ea WHERE length(sentence) >= 20),
ec AS (SELECT query_id, place, pos, round(0.60 * final_score + 0.40 * {OVERLAP.format(a="list_distinct(q.terms)", b="own")}, 9) AS score, sentence || ' [Nguon ' || place || ': ' || source_name || ', trang 1]' AS citation FROM eb JOIN q USING (query_id)),
evidence AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, pos) AS rank, score, citation FROM ec QUALIFY rank <= 40)"""
VARIANTS = f"""va AS (SELECT item_id AS query_id, {spaces("text")} AS base FROM benchmark),
vb AS (SELECT *, {matched("base")} AS kept, {matched("base", False)} AS bare FROM va), vc AS (SELECT *, {expanded("bare")} AS full_text FROM vb),
vd AS (SELECT query_id, list_filter([base, kept, bare, full_text, array_to_string({terms("full_text")}, ' ')], lambda x: x <> '') AS raw FROM vc),
v AS (SELECT query_id, list_filter(raw, lambda x, i: list_position(raw, x) = i)[1:4] AS vs FROM vd)"""
STORE = """dd AS (SELECT doc_id AS document_id, source || '_' || doc_id || '.txt' AS source_name, lang AS subject, source FROM documents),
pp AS (SELECT source AS title, 'path/' || source AS section_path, 'parent of ' || count(*) AS content FROM documents GROUP BY source)"""
NAMED = "nm AS (SELECT doc_id AS chunk_id, text AS content, concat_ws(' ', string_split(text, ' ')[1], 'Lop', doc_id % 14, 'chuong', doc_id % 30, source, 1890 + doc_id % 200) AS name FROM documents)"


def hybrid(tail: str, *more: str) -> str:
    return "WITH " + ",\n".join([HYBRID, *more]) + "\n" + tail


def page_text() -> str:
    x = "regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
    for pattern, to in MARKS:
        x = sub(x, pattern, to)
    return x


LINES = f"""pt AS (SELECT page_id AS document_id, {clean(page_text())} AS text FROM pages),
ln AS (SELECT document_id, unnest(range(len(ls))) AS pos, {strip("unnest(ls)")} AS line FROM (SELECT document_id, string_split(text, chr(10)) AS ls FROM pt))"""
SECTIONS = f"""WITH {LINES},
h AS (SELECT *, line <> '' AND {heading("line")} AS heading FROM ln),
pa AS (SELECT *, sum(heading::INT) OVER (PARTITION BY document_id ORDER BY pos) AS part FROM h),
g AS (SELECT document_id, part, coalesce(max(CASE WHEN heading THEN {hashes("line")} END), 'Section') AS title, {clean("coalesce(string_agg(CASE WHEN NOT heading THEN line END, chr(10) ORDER BY pos), '')")} AS body FROM pa GROUP BY ALL),
u AS (SELECT document_id, part, title, body FROM g WHERE body <> '' UNION ALL SELECT document_id, 0, 'Section', text FROM pt WHERE text <> '' AND document_id NOT IN (SELECT document_id FROM g WHERE body <> ''))
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY part) - 1 AS section_index, title, body FROM u"""
NOISE = f"""WITH a AS (SELECT conv_id AS document_id, turn + 1 AS page_number, text AS raw, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS ls FROM conversations),
b AS (SELECT *, ls[1] AS first, ls[-1] AS last, count(*) OVER (PARTITION BY document_id) AS n FROM a),
k AS (SELECT *, coalesce(n >= 3 AND first IS NOT NULL AND length(first) <= 120 AND count(*) OVER (PARTITION BY document_id, first) >= greatest(2, floor(n * 0.6)), false) AS top,
  coalesce(n >= 3 AND last IS NOT NULL AND length(last) <= 120 AND count(*) OVER (PARTITION BY document_id, last) >= greatest(2, floor(n * 0.6)), false) AS bottom FROM b),
r AS (SELECT *, CASE WHEN top THEN ls[2:] ELSE ls END AS rest FROM k)
SELECT document_id, page_number::INT AS page_number, CASE WHEN n >= 3 THEN {clean("array_to_string(CASE WHEN bottom AND len(rest) > 0 THEN rest[1:len(rest) - 1] ELSE rest END, chr(10))")} ELSE raw END AS text FROM r"""


def metadata() -> str:
    grade, chapter = r"(?i)(?:^|[^\p{L}\p{N}_])(?:lop|grade)\s*([1-9]|1[0-2])(?:[^\p{L}\p{N}_]|$)", r"(?i)(?:^|[^\p{L}\p{N}_])(?:chuong|chapter|phan|muc|section)\s*([0-9]{1,2}[a-z]?)(?:[^\p{L}\p{N}_]|$)"
    year = r"(?:^|[^\p{L}\p{N}_])(19\d{2}|20\d{2})(?:[^\p{L}\p{N}_]|$)"
    subject = "CASE " + " ".join(f"WHEN {any_of('x', hints)} THEN {quoted(label)}" for label, hints in T.SUBJECTS) + " ELSE '' END"
    return f"""WITH {NAMED}, a AS (SELECT *, {strip("name")} AS source, {matched(strip("name"), False)} AS m, {spaces("string_split(content, chr(10))[1]")} AS line FROM nm), b AS (SELECT *, {expanded("m")} AS x FROM a)
SELECT chunk_id, {strip(f"CASE WHEN {strip('content')} <> '' AND length(line) BETWEEN 4 AND 180 THEN line ELSE source END")} AS title, {subject} AS subject,
  CASE WHEN regexp_extract(x, {quoted(grade)}, 1) <> '' THEN 'Lop ' || regexp_extract(x, {quoted(grade)}, 1) ELSE '' END AS grade,
  CASE WHEN regexp_extract(x, {quoted(chapter)}, 1) <> '' THEN 'Chuong ' || regexp_extract(x, {quoted(chapter)}, 1) ELSE '' END AS chapter,
  regexp_extract(x, {quoted(year)}, 1) AS published_year, source FROM b"""


def title() -> str:
    return f"""WITH a AS (SELECT doc_id AS chunk_id, {clean("CASE WHEN doc_id % 2 = 0 THEN 'Section' ELSE source || '_' || doc_id || '.txt' END")} AS hint, {clean("string_split(text, chr(10))[1]")} AS line FROM documents),
b AS (SELECT chunk_id, CASE WHEN hint <> '' AND {folded("hint")} NOT IN ('section', 'chuong', 'chapter') THEN hint WHEN {heading("line")} THEN {hashes("line")} ELSE coalesce({sentences("line")}[1], line) END AS title FROM a)
SELECT chunk_id, CASE WHEN title = '' THEN 'Section' WHEN length(title) <= 120 THEN title ELSE {sub("title[1:117]", WS + "+$", "")} || '...' END AS title FROM b"""


def signature() -> str:
    rows = ", ".join(f"({i}, [{', '.join(map(repr, map(float, normal)))}]::DOUBLE[])" for i, normal in enumerate(dense.planes(64)))
    return f"WITH n(bit, normal) AS (VALUES {rows}) SELECT vec_id AS chunk_id, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], normal) >= 0 THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS sig FROM embeddings, n GROUP BY vec_id"


def lsh() -> str:
    """The probe of buckets in SQL: running sums over the probes of each query, nearest by Hamming distance where all are short."""
    masks = ", ".join(f"({i}, {int(m)}::BIGINT)" for i, m in enumerate(dense.probes(16)))
    return f"""WITH g AS MATERIALIZED ({signature()}), sizes AS (SELECT sig, count(*) AS n FROM g GROUP BY sig), t AS (SELECT least(count(*), 288) AS target FROM g),
m(probe, mask) AS (VALUES {masks}),
q AS (SELECT chunk_id AS query_id, sig AS own FROM g WHERE chunk_id % 20 = 0),
o AS (SELECT query_id, probe, xor(own, mask) AS sig FROM q, m),
w AS (SELECT query_id, o.sig, coalesce(n, 0) AS n, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY query_id ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(coalesce(n, 0)) OVER (PARTITION BY query_id) AS held FROM o LEFT JOIN sizes USING (sig)),
near AS (SELECT query_id, chunk_id FROM w JOIN g USING (sig), t WHERE held >= target AND before < target),
far AS (SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY bit_count(xor(own, sig)), chunk_id) AS r FROM q, g WHERE query_id IN (SELECT query_id FROM w, t WHERE held < target)), t WHERE r <= 2 * target),
s AS (SELECT query_id, chunk_id, {DOT} AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM far) JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_id)
{top("s", 48)}"""


#: The settings' documented defaults.
DEFAULTS = """child_target=450 child_min=200 child_max=700 parent_target=1200 parent_min=900 parent_max=1600 overlap_sentences=2 group_min=2 group_max=4 top_k=3 top_k_dense=48 top_k_sparse=48
fusion_top_k=96 rerank_top_k=10 ann_candidates=12 min_similarity=0.3 use_hybrid=True use_lsh=False use_reranker=True compress_evidence=True rerank_low=0.34 low_confidence=0.46 low_margin=0.06 low_gap=0.04
evidence_sentence_min=15 evidence_sentence_max=40 evidence_chunk_min=6 evidence_chunk_max=10 evidence_min_tokens=1500 evidence_max_tokens=3000 embedding_model=hashing api_key="""


def facts_sql() -> str:
    """Aggregate: the local facts of a question's contexts."""
    line = f"'- ' || {summary('content', 240)} || ' [Nguon ' || place || ']'"
    return f"'FACTS:' || chr(10) || string_agg({line}, chr(10) ORDER BY place) || chr(10) || 'CONFLICTS:' || chr(10) || '- Chua xac dinh mau thuan tu local fallback.' || chr(10) || 'MISSING:' || chr(10) || '- Co the thieu du lieu neu can lap luan sau hon.'"


SOURCES = "string_agg('- [Nguon ' || place || '] ' || source_name || ' (trang 1)', chr(10) ORDER BY place)"


def blocks_sql() -> str:
    """Aggregate: the contexts of a question as a prompt shows them."""
    clip = lambda n: f"CASE WHEN length({strip('content')}) > {n} THEN {strip('content')}[1:{n}] || '...' ELSE {strip('content')} END"
    points = " || ' / ' || ".join(f"printf('%.3f', {c}_score)" for c in ("dense", "sparse", "rrf", "rerank"))
    lines = ["'[Nguon ' || place || ']'", "'File: ' || source_name", "'Tieu de: ' || source_name", "'Mon/Lop/Chuong: ' || subject || ' / - / -'", "'Trang: 1'", "'Section: ' || parent_key", f"'Diem Dense/Sparse/RRF/Rerank: ' || {points}", f"'Doan child: ' || {clip(420)}", f"'Noi dung parent: ' || {clip(950)}"]
    return f"string_agg({' || chr(10) || '.join(lines)}, chr(10) || chr(10) ORDER BY place)"


def facts() -> str:
    return hybrid(f"SELECT query_id, {facts_sql()} AS facts_text, {SOURCES} AS sources_text FROM ctx GROUP BY query_id", CONTEXTS)


def rendered() -> str:
    return hybrid(f"SELECT query_id, {blocks_sql()} AS context_text FROM ctx GROUP BY query_id", CONTEXTS)


def hashed() -> str:
    """Signed counts of words and word pairs by their MD5 digests, to unit length."""
    return f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({folded("text")}, '{WS}+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT doc_id, unnest(ws) AS feature FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
c AS (SELECT doc_id, ('0x' || substr(md5(feature), 1, 8))::BIGINT AS code FROM f),
v AS (SELECT doc_id, (code % 256)::INT AS pos, sum(CASE WHEN code >= 2147483648 THEN 1 ELSE -1 END) AS x FROM c GROUP BY ALL)
SELECT doc_id AS chunk_id, pos, (x::FLOAT / sqrt(sum(x * x) OVER (PARTITION BY doc_id))::FLOAT)::DOUBLE AS x FROM v WHERE x <> 0"""


def result() -> str:
    text = {"source_path": "'/' || source_name", "page_number": "'1'", "location_number": "'1'", "location_label": "'page'", "chunk_index": "'0'", "child_content": "content", "parent_title": "parent_key", "section_path": "''", "title": "''", "grade": "''", "chapter": "''", "published_year": "''", "source": "parent_key", "file_type": "'.txt'", "doc_type": "'note'"}
    number = {"similarity": "dense_score"} | {f"{n}_score": f"{n}_score" for n in ("lexical", "dense", "sparse", "rrf", "rerank", "final")}
    columns = ", ".join(f"{e} AS {n}" for n, e in text.items()) + ", " + ", ".join(f"round({e}::DOUBLE, 6) AS {n}" for n, e in number.items())
    return hybrid(f"SELECT query_id, place, source_name, content, subject, {columns} FROM ctx", CONTEXTS)


def unit_rows(source: str) -> str:
    """Lines classified and paragraphs joined as islands; source gives document_id and a clean text."""
    formula, heading, bullet = r"[=<>^]|\$.*\$", r"(?i)^(#{1,6}\s+|chuong\s+\d+|chapter\s+\d+|\d+(\.\d+){0,3}\s+)", r"^([-*+]|\d+[.)])\s+"
    return f"""WITH src AS ({source}),
a AS (SELECT document_id, i, {strip("line")} AS line FROM (SELECT document_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT document_id, string_split(text, chr(10)) AS ls FROM src))),
b AS (SELECT *, CASE WHEN line = '' THEN '' WHEN regexp_matches(line, {quoted(heading)}) THEN 'heading' WHEN regexp_matches(line, {quoted(bullet)}) THEN 'bullet'
  WHEN length(line) < 180 AND regexp_matches(line, {quoted(formula)}) THEN 'formula' ELSE 'paragraph' END AS kind FROM a),
c AS (SELECT *, CASE WHEN kind = 'paragraph' AND lag(kind) OVER w = 'paragraph' THEN 0 ELSE 1 END AS first FROM b WINDOW w AS (PARTITION BY document_id ORDER BY i)),
d AS (SELECT *, sum(first) OVER (PARTITION BY document_id ORDER BY i) AS island FROM c),
e AS (SELECT document_id, island, any_value(kind) AS kind, {spaces("string_agg(line, ' ' ORDER BY i)")} AS unit FROM d GROUP BY document_id, island)
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY island) - 1)::INT AS pos, unit, kind FROM e WHERE unit <> ''"""


def told(expression: str) -> str:
    """A text for each question, of what prompts tell (columns as in the catalogue's told())."""
    return hybrid(
        f"SELECT query_id, {expression} FROM told", CONTEXTS, GATE, BUDGET, EVIDENCE,
        f"fx AS (SELECT query_id, {facts_sql()} AS facts, {SOURCES} AS sources, {blocks_sql()} AS contexts FROM budget GROUP BY query_id)",
        "ci AS (SELECT query_id, string_agg('- ' || citation, chr(10) ORDER BY rank) AS evidence FROM evidence GROUP BY query_id)",
        f"told AS (SELECT gate.query_id, text AS question, printf('%.3f', gate.confidence) AS confidence, {intent('text')} AS intent, facts, sources, contexts, coalesce(evidence, {quoted(prompts.NO_EVIDENCE)}) AS evidence FROM gate JOIN benchmark ON item_id = gate.query_id LEFT JOIN fx ON fx.query_id = gate.query_id LEFT JOIN ci ON ci.query_id = gate.query_id)",
    )


def template(text: str) -> str:
    """A prompt with {name} for columns, as SQL."""
    parts = re.split(r"\{(\w+)\}", text)
    return " || ".join(quoted(x) if i % 2 == 0 else f"coalesce({x}, '')" for i, x in enumerate(parts))


def sql() -> dict[str, str]:
    say = "CASE i " + " ".join(f"WHEN {quoted(k)} THEN {quoted(T.CLARIFY_HEAD + v)}" for k, v in T.CLARIFY.items()) + " END"
    last = f"{sentences('text')}"
    path = lambda a, b: f"CASE WHEN {a} <> '' AND {b} <> '' AND {folded(a)} <> {folded(b)} THEN {a} || ' > ' || {b} WHEN {b} <> '' THEN {b} ELSE {a} END"
    head = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Question: ' WHEN 2 THEN 'DAP AN ' ELSE 'a list' || chr(10) || '- ' END || text"
    asks, replies = (f"({' OR '.join(f'starts_with({folded("x")}, {quoted(p)})' for p in starts)})" for starts in (("cau hoi", "question"), ("loi giai", "dap an", "answer")))
    return {
        "lsh_topk": lsh(),
        "settings": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, _, v in (x.partition("=") for x in DEFAULTS.split())) + ") AS s(setting, value)",
        "text_scan": f"SELECT '/' || source || '_' || doc_id || '.txt' AS source_path, CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.markdown' ELSE '.log' END AS file_type, 1 AS page_number, {clean('text')} AS text, false AS failed FROM documents",
        "strip_diacritics": on_documents(out="strip_accents(text)"),
        "text_units": unit_rows(f"SELECT doc_id AS document_id, {clean('text')} AS text FROM documents"),
        "page_units": unit_rows(f"SELECT page_id AS document_id, {clean(page_text())} AS text FROM pages"),
        "block_kinds": f"SELECT doc_id, {asks} AS question, {replies} AS answer, contains(x, chr(10) || '- ') OR contains(x, chr(10) || '* ') OR {asks} OR {replies} OR regexp_matches(x, '[=<>^]') AS protected FROM (SELECT doc_id, {head} AS x FROM documents)",
        "e5_prefix": on_documents(out="'passage: ' || text"),
        "chunk_scan": f"WITH {STORE} SELECT doc_id AS chunk_id, text AS content, source_name, subject, coalesce(title, '') AS parent_title, coalesce(section_path, '') AS section_path FROM documents JOIN dd ON doc_id = document_id LEFT JOIN pp ON dd.source = title",
        "replace_vectors": "SELECT vec_id AS chunk_id, unnest(range(64))::INT AS pos, unnest(embedding)::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END AS x FROM embeddings",
        "vector_scan": "SELECT vec_id AS chunk_id, len(embedding)::INT AS dim FROM embeddings",
        "path_lookup": "SELECT doc_id AS document_id FROM documents WHERE source || '_' || doc_id || '.txt' = 'src3_23.txt'",
        "facts_prompt": told(template(prompts.FACTS) + " AS prompt"),
        "answer_prompt": told(template(prompts.ANSWER) + " AS prompt"),
        "local_answer": told(f"CASE WHEN sources IS NULL THEN {quoted(prompts.NO_CONTEXT)} ELSE {template(prompts.LOCAL)} END AS answer"),
        "normalize_ws": on_documents(out=spaces("text")),
        "match_text": on_documents(kept=matched("text"), bare=matched("text", False)),
        "ocr_fix": on_documents(out=ocr("text")),
        "clean_text": on_documents(out=clean("text")),
        "abbrev_expand": on_documents(out=expanded("text")),
        "token_count": on_documents(n=token_count("text")),
        "tokens_exploded": f"SELECT doc_id, unnest(range(len(w)))::INT AS pos, unnest(w) AS token FROM (SELECT doc_id, {tokens('text')} AS w FROM documents)",
        "term_freq": f"WITH {TOKENS}, {POSTINGS} SELECT chunk_id, term, tf FROM p",
        "doc_freq": f"WITH {TOKENS}, {POSTINGS} SELECT term, df FROM f",
        "corpus_stats": f"WITH {TOKENS}, {LENGTHS} SELECT n_docs, round(mean_length, 6) AS mean_length FROM st",
        "sparse_corpus": f"WITH {TOKENS} SELECT chunk_id, array_to_string(terms, ' ') AS terms FROM t",
        "sentences": f"SELECT doc_id, unnest(range(len(w)))::INT AS pos, unnest(w) AS sentence FROM (SELECT doc_id, {sentences('text')} AS w FROM documents)",
        "sentence_overlap": f"SELECT doc_id, CASE WHEN len(w) <= 1 THEN '' ELSE {clean("array_to_string(w[-2:], ' ')")} END AS out FROM (SELECT doc_id, {last} AS w FROM documents)",
        "intent": on_documents(intent=intent("text")),
        "keywords": f"SELECT doc_id, concat_ws(',', {', '.join(f'CASE WHEN {any_of("m", v)} THEN {quoted(k)} END' for k, v in T.KEYWORDS)}) AS keywords FROM (SELECT doc_id, {matched('text', False)} AS m FROM documents)",
        "doc_metadata": metadata(),
        "doc_type": f"WITH {NAMED} SELECT chunk_id, CASE WHEN chunk_id % 4 = 2 OR {any_of('lower(name)', T.SLIDE_HINTS)} THEN 'slide' WHEN {any_of('lower(name)', T.BOOK_HINTS)} OR chunk_id % 4 = 1 THEN 'book' ELSE 'note' END AS doc_type FROM nm",
        "context_header": "SELECT doc_id AS chunk_id, concat_ws(' · ', lang, 'Lop 9', source, CASE WHEN doc_id % 3 > 0 THEN 'Trang ' || doc_id % 3 END) AS header FROM documents",
        "section_path": f"WITH a AS (SELECT doc_id AS chunk_id, {clean('upper(source)')} AS a, {clean("CASE WHEN doc_id % 2 = 0 THEN source ELSE source || '_' || doc_id || '.txt' END")} AS b FROM documents) SELECT chunk_id, {path('a', 'b')} AS path FROM a",
        "query_variants": f"WITH {VARIANTS} SELECT query_id, array_to_string(vs, '|') AS variants FROM v",
        "heading_lines": f"WITH {LINES} SELECT document_id, pos::INT AS pos, {heading('line')} AS heading FROM ln",
        "parent_title": title(),
        "trim_summary": on_documents(out=summary("text", 280)),
        "sections": SECTIONS,
        "page_noise": NOISE,
        "embed_payload": "SELECT doc_id AS chunk_id, concat_ws(' · ', lang, 'Lop 10', source, 'Trang 1') || chr(10) || text AS payload FROM documents",
        "hashed_embedding": hashed(),
        "l2_normalize": "WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings) SELECT vec_id AS chunk_id, unnest(range(len(v)))::INT AS pos, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) AS x FROM a",
        "dense_topk": f"WITH a AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) {top('a', 48)}",
        "dense_multi_variant_max": f"WITH a AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), b AS ({top('a', 48)}), m AS (SELECT query_id % 100 AS query_id, chunk_id, max(score) AS score FROM b GROUP BY ALL) {top('m', 48)}",
        "lsh_signature": signature(),
        "bm25_topk": f"WITH {INDEX},\n{SPARSE} SELECT query_id, chunk_id, score FROM s",
        "bm25_multi_variant": f"""WITH {INDEX},\n{VARIANTS},
vt AS (SELECT query_id, i AS variant, {terms("x")} AS terms FROM (SELECT query_id, unnest(vs) AS x, unnest(range(len(vs))) AS i FROM v)),
qt AS (SELECT query_id, variant, term, count(*) AS qtf FROM (SELECT query_id, variant, unnest(terms) AS term FROM vt) GROUP BY ALL),
sa AS (SELECT query_id, variant, chunk_id, round(sum({WEIGHT}), 6) AS score FROM qt JOIN p USING (term) JOIN f USING (term) JOIN l USING (chunk_id), st GROUP BY ALL),
m AS (SELECT query_id, chunk_id, max(score) AS score FROM sa WHERE score > 0 GROUP BY ALL) {top("m", 48)}""",
        "rrf_fuse": f"WITH {INDEX},\n{SPARSE},\n{DENSE},\n{fuse()} SELECT query_id, chunk_id, rrf_score, rank FROM fused",
        "rrf_dense_only": f"WITH {DENSE},\nnone AS (SELECT * FROM d WHERE false),\n{fuse('d', 'none')} SELECT query_id, chunk_id, rrf_score, rank FROM fused",
        "lexical_overlap": hybrid("SELECT query_id, chunk_id, lexical_score FROM scored"),
        "relevance_filter": hybrid("SELECT query_id, chunk_id FROM scored"),
        "rerank_fallback": hybrid("SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score FROM scored"),
        "rerank_payload": f"SELECT doc_id AS chunk_id, concat_ws(chr(10), source, nullif({strip('text')}[1:1800], ''), nullif({strip('text')}[1:500], '')) AS payload FROM documents",
        "sigmoid_clip": "WITH a AS (SELECT vec_id AS chunk_id, vec_id % 7 AS query_id, round(embedding[1]::DOUBLE * CASE WHEN vec_id % 7 < 3 THEN 1 ELSE 9 END + CASE WHEN vec_id % 7 = 1 THEN 0.5 ELSE 0 END, 6) AS raw FROM embeddings), b AS (SELECT *, min(raw) OVER w < 0 OR max(raw) OVER w > 1 AS outside FROM a WINDOW w AS (PARTITION BY query_id)) SELECT chunk_id, query_id, round(least(1, greatest(0, CASE WHEN outside THEN 1 / (1 + exp(-raw)) ELSE raw END)), 6) AS rerank_score FROM b",
        "final_score": hybrid("SELECT query_id, chunk_id, final_score FROM scored"),
        "unique_parents": hybrid("SELECT query_id, chunk_id, place FROM ctx", CONTEXTS),
        "confidence": hybrid("SELECT query_id, confidence FROM gate", CONTEXTS, GATE),
        "needs_clarification": hybrid("SELECT query_id, needs_clarification FROM gate", CONTEXTS, GATE),
        "clarification_text": f"SELECT doc_id, {say} AS answer FROM (SELECT doc_id, {intent('text')} AS i FROM documents)",
        "evidence_budget": hybrid("SELECT query_id, chunk_id, place, tokens FROM budget", CONTEXTS, BUDGET),
        "evidence_sentences": hybrid("SELECT query_id, rank, score, citation FROM evidence", CONTEXTS, BUDGET, EVIDENCE),
        "context_blocks": rendered(),
        "local_facts": facts(),
        "result_json": result(),
        "hydrate_join": f"WITH {STORE} SELECT 100000000 - document_id AS ord, document_id AS chunk_id, source_name, subject, coalesce(title, '') AS parent_title, coalesce(section_path, '') AS section_path, coalesce(content, '') AS parent_content, CASE WHEN title IS NOT NULL THEN 1 END AS parent_page_number FROM dd LEFT JOIN pp ON source = title WHERE document_id IN (SELECT vec_id FROM embeddings)",
        "list_documents": "SELECT doc_id AS document_id, source || '_' || doc_id || '.txt' AS source_name, 1::BIGINT AS chunk_count FROM documents",
        "count_chunks": "SELECT count(*) AS n FROM documents",
        "upsert_latest": "SELECT source || '/' || lang AS source_path, min(doc_id) AS document_id, source || '_' || max(doc_id) || '.txt' AS source_name, source || '_' || max(doc_id) || '.txt' AS title, 1 AS total_pages FROM documents GROUP BY source, lang",
        "delete_cascade": "SELECT doc_id AS chunk_id, true AS mapped FROM documents WHERE source <> 'src3'",
        "dedupe_inputs": "SELECT DISTINCT source || '/' || lang AS source_path FROM documents",
        "hybrid_retrieve": hybrid("SELECT query_id, place, chunk_id, dense_score, sparse_score, rrf_score, round(lexical_score, 6) AS lexical_score, final_score FROM ctx", CONTEXTS),
    }
