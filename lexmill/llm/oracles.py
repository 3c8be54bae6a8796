"""SQL counterparts of the training-data queries, where SQL can express them."""

from __future__ import annotations

from .codes import ENTRIES, PARTS, ROUNDS, SCALE
from .quality import MEASURES, MIN_GROUP, MIN_WORDS, SPREAD
from .queries import BLOCK_ROWS, SHARES

_K = list(SHARES.values())
_TOTAL = sum(_K)
_NUMBER = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SHARES) if s is not None) + f" ELSE {list(SHARES).index(None)} END"

#: Earliest deadline first, slot by slot: counts so far, then the released source of least deadline.
OP1 = f"""WITH RECURSIVE k AS (SELECT {_K}::BIGINT[] AS k), e AS (
 SELECT -1::BIGINT AS slot, NULL::BIGINT AS pick, list_transform(k, lambda x: 0::BIGINT) AS had FROM k
 UNION ALL SELECT slot + 1, pick, list_transform(had, lambda h, i: h + (i - 1 = pick)::BIGINT) FROM (
  SELECT slot, had, (list_min(list_filter(list_transform(had, lambda h, i: CASE WHEN h * {_TOTAL} < (slot + 2) * k[i] THEN (-((-(h + 1) * {_TOTAL}) // k[i])) * 1000 + i - 1 END), lambda x: x IS NOT NULL)) % 1000)::BIGINT AS pick
  FROM e, k WHERE slot + 1 < {_TOTAL})),
 period AS (SELECT slot, pick AS share_no, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS nth FROM e WHERE slot >= 0),
 d AS (SELECT doc_id, source, {_NUMBER} AS share_no, row_number() OVER (PARTITION BY {_NUMBER} ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT, doc_id) - 1 AS pos FROM documents),
 b AS (SELECT doc_id, source, share_no, k.k[share_no + 1] AS share, pos // {BLOCK_ROWS} AS block, (pos % {BLOCK_ROWS})::INTEGER AS place FROM d, k)
SELECT doc_id, source, block, place, block // share * {_TOTAL} + p.slot AS slot, block * {_TOTAL} // share AS released, ((block + 1) * {_TOTAL} + share - 1) // share AS deadline
 FROM b JOIN period p ON p.share_no = b.share_no AND p.nth = block % share"""

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

_RATIO = {m: f"coalesce(({top} * {scale}) // nullif({bottom}, 0), 0)" for m, (top, bottom, scale, _) in MEASURES.items()}
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {r} AS v, {MEASURES[m][3]} AS slack FROM c WHERE n_words >= {MIN_WORDS}" for m, r in _RATIO.items())


def _fence(name: str, keys: str) -> str:
    part = f"PARTITION BY {keys}, measure" if keys else "PARTITION BY measure"
    group = f"{keys}, measure" if keys else "measure"
    k = f"{keys}, " if keys else ""
    return f"""{name}0 AS (SELECT {k}measure, b, slack, sum(n) OVER ({part} ORDER BY b) AS upto, sum(n) OVER ({part}) AS total FROM (SELECT {k}measure, b, slack, count(*) AS n FROM bins GROUP BY ALL)),
 {name} AS (SELECT {k}measure, max(total) AS total, min(CASE WHEN upto * 4 >= total * 3 THEN b END) + greatest({SPREAD} * (min(CASE WHEN upto * 4 >= total * 3 THEN b END) - min(CASE WHEN upto * 4 >= total THEN b END)), any_value(slack)) AS fence FROM {name}0 GROUP BY {group})"""


_PICK = f"CASE WHEN own.total >= {MIN_GROUP} THEN own.fence WHEN la.total >= {MIN_GROUP} THEN la.fence ELSE co.fence END"
_IN = " AND ".join(f"coalesce({r} <= max(f) FILTER (WHERE measure = '{m}'), true)" for m, r in _RATIO.items())
_COLS = "doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines"

OP5 = rf"""WITH w AS (SELECT doc_id, lang, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
 g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM w, unnest(range(1, greatest(len(w) - 1, 1))) AS t(i)),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
 rc AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) AS t(k) GROUP BY doc_id),
 c AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rc.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN rc USING (doc_id)),
 long AS ({_LONG}), bins AS (SELECT lang, source, measure, slack, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS b FROM long),
 {_fence('own', 'lang, source')}, {_fence('la', 'lang')}, {_fence('co', '')},
 f AS (SELECT own.lang, own.source, own.measure, {_PICK} AS f FROM own JOIN la ON la.lang IS NOT DISTINCT FROM own.lang AND la.measure = own.measure JOIN co ON co.measure = own.measure),
 j AS (SELECT {_COLS.replace('lang', 'c.lang').replace('source', 'c.source')}, {_IN} AS inside FROM c LEFT JOIN f ON f.lang IS NOT DISTINCT FROM c.lang AND f.source IS NOT DISTINCT FROM c.source GROUP BY {_COLS.replace('lang', 'c.lang').replace('source', 'c.source')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND inside AS kept, lang, source FROM j"""

OP7 = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages), h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to FROM h"""

OP10 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], chr(1)) AS g FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(doc_id, seen) AS (SELECT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
 m AS (SELECT doc_id, min(seen) AS comp FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id, coalesce(m.comp, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_FIELD = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"
_SHIFTED = "c"
for _ in range(8):  # one byte of the CRC-32, bit by bit
    _SHIFTED = f"list_transform([{_SHIFTED}], lambda c: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)[1]"
_CRC = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda s, b: list_transform([xor(s, b)], lambda c: {_SHIFTED})[1], 4294967295::BIGINT), 4294967295::BIGINT)"

OP11 = f"""WITH RECURSIVE f AS (SELECT doc_id, lang, {_LEAF("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
 g AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS member FROM (SELECT DISTINCT lang FROM f)),
 d AS (SELECT f.*, g.member, row_number() OVER (PARTITION BY g.member ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g.member) AS n FROM f JOIN g ON f.lang IS NOT DISTINCT FROM g.lang),
 t(member, level, idx, n, digest) AS (SELECT member, 0, pos, n, leaf FROM d UNION ALL SELECT member, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY member, level, idx // 8, n),
 s AS (SELECT member, digest, max(member) OVER () + 1 AS n FROM t WHERE n = 1),
 u(level, idx, n, digest) AS (SELECT 100, member, n, digest FROM s UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 8, n),
 w(member, pos, level, idx, n, top) AS (SELECT member, pos, 0, pos, n, false FROM d UNION ALL
  SELECT w.member, pos, CASE WHEN w.n = 1 THEN 100 ELSE level + 1 END, CASE WHEN w.n = 1 THEN w.member ELSE idx // 8 END, CASE WHEN w.n = 1 THEN s.n ELSE (w.n + 7) // 8 END, top OR w.n = 1 FROM w JOIN s USING (member) WHERE NOT (top AND w.n = 1)),
 a AS (SELECT member, level, idx, digest FROM t UNION ALL SELECT NULL, level, idx, digest FROM u),
 p AS (SELECT w.member, w.pos, w.level, w.idx, a.idx AS other, a.digest FROM w JOIN a ON a.level = w.level AND a.idx // 8 = w.idx // 8 AND (w.top OR a.member = w.member) WHERE w.n > 1),
 q AS (SELECT member, pos, sha256(string_agg(digest, '' ORDER BY level, other)) AS proof FROM p WHERE other <> idx GROUP BY member, pos),
 r(member, pos, level, digest, k) AS (SELECT member, pos, (SELECT min(level) FROM w WHERE w.member = d.member AND w.pos = d.pos AND w.n > 1), coalesce(changed, leaf), 0 FROM d UNION ALL
  SELECT r.member, r.pos, min(nx.level), sha256(string_agg(CASE WHEN p.other = p.idx THEN r.digest ELSE p.digest END, '' ORDER BY p.other)), r.k + 1 FROM r JOIN p ON p.member = r.member AND p.pos = r.pos AND p.level = r.level
   LEFT JOIN (SELECT member, pos, level, lag(level) OVER (PARTITION BY member, pos ORDER BY level) AS before FROM w WHERE n > 1) nx ON nx.member = r.member AND nx.pos = r.pos AND nx.before = r.level GROUP BY r.member, r.pos, r.k),
 e AS (SELECT member, pos, digest FROM r WHERE level IS NULL)
SELECT doc_id, leaf, s.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.digest AS folded_root, e.digest = (SELECT digest FROM u WHERE n = 1) AS verified
 FROM d JOIN s USING (member) JOIN e USING (member, pos) LEFT JOIN q USING (member, pos)"""

_GAP = "list_sum(list_transform(list_zip(p.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT"
_ROUND = "".join(
    f""",
 a{i} AS MATERIALIZED (SELECT vec_id, label, part, v, d // 256 AS d, d % 256 AS entry FROM (SELECT vec_id, label, p.part, any_value(p.v) AS v, min({_GAP} * 256 + c.entry) AS d FROM p JOIN c{i} c ON c.part = p.part GROUP BY vec_id, label, p.part))"""
    + (f""",
 c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT part, entry, list((s // n - (s % n < 0)::BIGINT)::BIGINT ORDER BY place) AS v FROM (SELECT part, entry, place, sum(v[place])::BIGINT AS s, count(*) AS n FROM a{i}, unnest(range(1, len(v) + 1)) AS t(place) GROUP BY ALL) GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry)""" if i < ROUNDS else "")
    for i in range(ROUNDS + 1)
)
OP13 = f"""WITH w AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v FROM w, unnest(range({PARTS})) AS t(part)),
 c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM (SELECT * FROM p WHERE vec_id IN (SELECT vec_id FROM w ORDER BY vec_id LIMIT {ENTRIES}))){_ROUND},
 o AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label),
 b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, b"""

SQL: dict[str, str] = {
    "op1_mix_sources": OP1, "op3_exact_top_k": OP3, "op5_quality_rules": OP5, "op7_warc_archive": OP7, "op10_near_duplicates": OP10,
    "op11_merkle_manifest": OP11, "op13_vector_codes": OP13,
}
