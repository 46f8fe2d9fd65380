"""SQL for DuckDB that gives the queries' rows on the same tables."""

from __future__ import annotations

from simloom.functions import rng
from simloom.functions.profiles import QUANT8, SEED_COMMON, SEED_COMPRESSED, SEED_HASH, SEED_MAX_LENGTH, FullProfile, bits, compressed, cross_dimensional, lossless, max_length
from simloom.plans.queries import WORDS

N = "n AS (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)"
P = f"{N}, p AS (SELECT x.p_name AS a, y.p_name AS b FROM n x JOIN n y ON x.p_name < y.p_name)"
QS = "q AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in WORDS) + "]) AS query)"


def nl(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


def jw(a: str, b: str, scale: float = 0.1) -> str:
    j = f"jaro_similarity({a}, {b})"
    common = "+ ".join(f"(CASE WHEN length({a}) >= {k} AND length({b}) >= {k} AND left({a}, {k}) = left({b}, {k}) THEN 1 ELSE 0 END)" for k in range(1, 5))
    return f"(CASE WHEN {j} >= 0.7 THEN {j} + ({common}) * {scale} * (1 - {j}) ELSE {j} END)"


def best(a: str, b: str) -> str:
    return f"greatest({nl(a, b)}, {jw(a, b)})"


#: 64-bit FNV-1a of ASCII features and their votes.
FNV = """list_reduce(list_transform(range(1, length(f) + 1), lambda i: ascii(substr(f, i, 1))::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"""


def hashes(source: str, text: str = "p_name") -> str:
    """CTEs up to ``hs``: text and its hash as a signed number."""
    return f"""
    fs AS (SELECT {text} AS t, unnest(list_concat(list_transform(range(1, greatest(length({text}) - 1, 1)), lambda i: substr(lower({text}), i, 3)), list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: w <> ''))) AS f FROM {source}),
    fh AS (SELECT t, {FNV} AS h FROM fs),
    vs AS (SELECT t, k, sum(CASE WHEN (h // (2::UHUGEINT ** k)::UHUGEINT) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM fh, range(0, 64) r(k) GROUP BY t, k),
    hu AS (SELECT t, sum(CASE WHEN v > 0 THEN (CASE WHEN k = 63 THEN -9223372036854775808::HUGEINT ELSE (1::BIGINT << k)::HUGEINT END) ELSE 0 END) AS h FROM vs GROUP BY t),
    hs AS (SELECT t, h::BIGINT AS hash FROM hu)"""


def _bits(a: str, b: str) -> str:
    return f"bit_count(xor({a}, {b}))"


#: Float arithmetic step by step, as in the engine.
NORM = "sqrt(list_reduce(embedding, lambda s, x: (s + (x * x)::FLOAT)::FLOAT, 0::FLOAT))::FLOAT"
COORD = "greatest(0, least(1023, floor(((((x + 1::FLOAT)::FLOAT / 2::FLOAT)::FLOAT * 1023::FLOAT)::FLOAT)::DOUBLE + 0.5)::INTEGER))"
UNIT = f"u AS (SELECT vec_id, list_transform(embedding, lambda x: (x / nrm)::FLOAT) AS embedding FROM (SELECT vec_id, embedding, list_reduce(list_transform(embedding, lambda x: (x * x)::FLOAT), lambda s, x: (s + x)::FLOAT) AS sq, sqrt(sq)::FLOAT AS nrm FROM embeddings))"
MORTON = f"""
{UNIT},
c AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: {COORD}) AS c FROM u),
b AS (SELECT vec_id, '0000001000000000' || '0000' || list_reduce(list_transform(range(0, 100), lambda i: ((c[10 - i % 10] >> (9 - i // 10)) & 1)::VARCHAR), lambda s, x: s || x) AS bits FROM c),
m AS (SELECT vec_id, list_reduce(list_transform(range(0, 24), lambda k: substr('0123456789abcdefghijklmnopqrstuv', 1 + list_reduce(list_transform(range(1, 6), lambda i: substr(bits, (5 * k + i)::INTEGER, 1)::INTEGER), lambda s, x: 2 * s + x), 1)), lambda s, x: s || x) AS id FROM b)"""


def _planes() -> str:
    rows = rng.hyperplanes(SEED_HASH, 64)
    return "planes AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, [{', '.join(f'{x:.9g}' for x in r.tolist())}]::FLOAT[])" for k, r in enumerate(rows)) + ") t(k, r))"


def _hash(source: str, cte: str = "") -> str:
    """CTEs up to ``vh``: vec_id, hi, lo."""
    head = f"{cte}, " if cte else ""
    return f"""{head}{_planes()},
    dots AS (SELECT vec_id, k, list_reduce(list_transform(range(1, 65), lambda i: (embedding[i] * r[i])::FLOAT), lambda s, x: (s + x)::FLOAT, 0::FLOAT) > 0 AS bit FROM {source}, planes),
    vh AS (SELECT vec_id, sum(CASE WHEN bit AND k >= 64 THEN (CASE WHEN k = 127 THEN -9223372036854775808::HUGEINT ELSE (1::BIGINT << (k - 64))::HUGEINT END) ELSE 0 END)::BIGINT AS hi,
      sum(CASE WHEN bit AND k < 64 THEN (CASE WHEN k = 63 THEN -9223372036854775808::HUGEINT ELSE (1::BIGINT << k)::HUGEINT END) ELSE 0 END)::BIGINT AS lo FROM dots GROUP BY vec_id)"""


#: Characters of base32 from a string of bits of a multiple of five.
B32 = "list_reduce(list_transform(range(0, length({bits}) // 5), lambda k: substr('0123456789abcdefghijklmnopqrstuv', 1 + list_reduce(list_transform(range(1, 6), lambda i: substr({bits}, (5 * k + i)::INTEGER, 1)::INTEGER), lambda s, x: 2 * s + x), 1)), lambda s, x: s || x)"
#: The hash's bits as text, the highest first.
BIT_TEXT = "bt AS (SELECT vec_id, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY k DESC) AS bits FROM dots GROUP BY vec_id)"
DOTP = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


#: Restricted Damerau distance: rows of the table one by one, each from the two above it.
OSA = """list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [[i]]), lambda acc, e: [acc[2], list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda r, j: list_append(r, least(acc[2][j[1] + 1] + 1, r[j[1]] + 1, acc[2][j[1]] + (CASE WHEN substr({a}, e[1][1]::INTEGER, 1) = substr({b}, j[1]::INTEGER, 1) THEN 0 ELSE 1 END), CASE WHEN e[1][1] > 1 AND j[1] > 1 AND substr({a}, e[1][1]::INTEGER, 1) = substr({b}, j[1]::INTEGER - 1, 1) AND substr({a}, e[1][1]::INTEGER - 1, 1) = substr({b}, j[1]::INTEGER, 1) THEN acc[1][j[1] - 1] + 1 ELSE 1000000 END)), e[1])], [range(0, length({b}) + 1), range(0, length({b}) + 1)])[2][length({b}) + 1]::INTEGER"""
#: UTF-8 bytes of a feature as numbers, FNV-1a of them, and the signed form of the hash.
FNV_BYTES = """list_reduce(list_transform(range(0, length(hex(encode(f))) // 2), lambda i: ((strpos('0123456789ABCDEF', substr(hex(encode(f)), (2 * i + 1)::INTEGER, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(f)), (2 * i + 2)::INTEGER, 1)) - 1)::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"""
#: The characters of Unicode's White_Space property.
BLANKS = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def text_hashes(source: str, key: str) -> str:
    """CTEs up to ``hk``: key and hash (signed) of texts of any characters; null texts as empty ones."""
    votes = ", ".join(f"sum(CASE WHEN (h >> {k}) & 1 = 1 THEN n ELSE -n END) > 0 AS b{k}" for k in range(63)) + ", sum(CASE WHEN h < 0 THEN n ELSE -n END) > 0 AS b63"
    value = " + ".join(f"CASE WHEN b{k} THEN {1 << k} ELSE 0 END" for k in range(63)) + " + CASE WHEN b63 THEN -9223372036854775808 ELSE 0 END"
    return f"""
    tk AS ({source}),
    tt AS (SELECT DISTINCT lower(coalesce(text, '')) AS t FROM tk),
    tf AS (SELECT t, unnest(CASE WHEN length(t) <= 2 THEN string_split(t, '') ELSE list_concat(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)), list_filter(string_split_regex(t, '{BLANKS}'), lambda w: w <> '')) END) AS f FROM tt),
    tn AS (SELECT t, f, count(*) AS n FROM tf WHERE f <> '' GROUP BY t, f),
    df AS (SELECT f, (CASE WHEN x >= 9223372036854775808::UHUGEINT THEN x::HUGEINT - 18446744073709551616::HUGEINT ELSE x::HUGEINT END)::BIGINT AS h FROM (SELECT f, {FNV_BYTES} AS x FROM (SELECT DISTINCT f FROM tn))),
    tv AS (SELECT t, {votes} FROM tn JOIN df USING (f) GROUP BY t),
    th AS (SELECT t, ({value})::BIGINT AS hash FROM tv),
    hk AS (SELECT {key}, coalesce(hash, 0)::BIGINT AS hash FROM tk LEFT JOIN th ON lower(coalesce(text, '')) = t)"""


#: Hilbert codes level by level: bits rotated and reflected, and what the next level turns by.
HILBERT = f"""
{{unit}},
c AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: {{coord}}) AS c FROM u),
l AS (SELECT vec_id, list_transform(range(0, 10), lambda k: list_reduce(list_transform(range(1, 11), lambda d: ((c[d] >> (9 - k)) & 1) << (d - 1)), lambda s, x: s + x)) AS l FROM c),
w AS (SELECT vec_id, k, l[k + 1] AS p FROM l, range(0, 10) r(k)),
h AS (
  WITH RECURSIVE z AS (
    SELECT vec_id, -1::BIGINT AS k, 0::BIGINT AS rot, 0::BIGINT AS ref, 0::BIGINT AS placed FROM l
    UNION ALL
    SELECT vec_id, k, (rot + zeros) % 10 AS rot, CASE WHEN gray & 1 = 0 THEN xor(ref, 1::BIGINT << (zeros % 10)) ELSE ref END AS ref, placed FROM (
      SELECT *, CASE WHEN gray = 0 THEN 32 ELSE bit_count(xor(gray, gray - 1)) - 1 END::BIGINT AS zeros FROM (
        SELECT *, xor(placed, placed >> 1) AS gray FROM (
          SELECT w.vec_id, w.k, z.rot, z.ref, xor(CASE WHEN z.rot = 0 THEN w.p ELSE ((w.p << (z.rot % 10)) | (w.p >> (10 - z.rot % 10))) & 1023 END, z.ref) AS placed
          FROM z JOIN w ON w.vec_id = z.vec_id AND w.k = z.k + 1)))
  )
  SELECT * FROM z
),
hb AS (SELECT vec_id, '0000001100000000' || '0000' || string_agg(list_reduce(list_transform(range(0, 10), lambda d: ((placed >> d) & 1)::VARCHAR), lambda s, x: s || x), '' ORDER BY k) AS bits FROM h WHERE k >= 0 GROUP BY vec_id)"""
#: Bits of a 32-bit float, a half-precision value, and eight bits of a number.
F32 = "((CASE WHEN {x} < 0 OR {x}::VARCHAR = '-0.0' THEN 2147483648 ELSE 0 END) + (CASE WHEN {x} = 0 THEN 0 ELSE (greatest(floor(log2(abs({x}::DOUBLE))), -126)::BIGINT + 127) * 8388608 + ((abs({x}::DOUBLE) / pow(2.0, greatest(floor(log2(abs({x}::DOUBLE))), -126)) - 1) * 8388608)::BIGINT END))::BIGINT"
HALF = "(CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x}::DOUBLE / pow(2.0, greatest(floor(log2(abs({x}::DOUBLE))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs({x}::DOUBLE))), -14) - 10) END)::FLOAT"


#: Bits of a half-precision value.
HALF_BITS = "lpad(bin(((CASE WHEN {x} < 0 THEN 32768 ELSE 0 END) + (CASE WHEN {x} = 0 THEN 0 WHEN abs({x}::DOUBLE) < pow(2.0, -14) THEN (abs({x}::DOUBLE) * 16777216)::BIGINT ELSE (floor(log2(abs({x}::DOUBLE)))::BIGINT + 15) * 1024 + ((abs({x}::DOUBLE) / pow(2.0, floor(log2(abs({x}::DOUBLE)))) - 1) * 1024)::BIGINT END))::BIGINT), 16, '0')"
EVENT_TEXTS = "SELECT event_id, concat_ws(' ', event_type, props) AS text FROM events"
TURNS = "SELECT conv_id || '-' || lpad(turn::VARCHAR, 6, '0') AS key, text FROM conversations"


def float_bits(x: str) -> str:
    return f"lpad(bin({F32.format(x=x)}), 32, '0')"


def full_ids(values: str, head: bytes, payload: str) -> str:
    """CTEs up to ``ids``: vec_id and the ID of a header and a payload of bits."""
    start = "".join(f"{b:08b}" for b in head)
    return f"""{values},
    raw AS (SELECT vec_id, '{start}' || {payload} AS bits FROM v),
    pad AS (SELECT vec_id, bits || repeat('0', ((5 - length(bits) % 5) % 5)::INTEGER) AS bits FROM raw),
    ids AS (SELECT vec_id, {B32.format(bits='bits')} AS id FROM pad)"""


def joined_bits(items: str, x: str = "x") -> str:
    return f"list_reduce(list_transform({items}, lambda x: {x}), lambda s, x: s || x)"


#: Range and integers of quantised values ``v`` of a row, step by step in floats.
def quantised(source: str, bits: int) -> str:
    most = (1 << bits) - 1
    return f"""q0 AS (SELECT vec_id, e, list_min(e) AS lo, list_max(e) AS hi FROM ({source})),
    v AS (SELECT vec_id, lo, hi, list_transform(e, lambda x: CASE WHEN hi = lo THEN {(1 << bits) // 2} ELSE least({most}, greatest(0, floor(((((x - lo)::FLOAT / (hi - lo)::FLOAT)::FLOAT * {most}::FLOAT)::FLOAT)::DOUBLE + 0.5)))::BIGINT END) AS q FROM q0)"""


def projected(seed: int, source_dims: int, target: int, dims: int) -> str:
    """CTE ``pr``: vec_id and ``e``, projected; sums of floats in order."""
    rows = rng.projection(seed, source_dims, target)[:, :dims]
    values = ", ".join(f"({k}, [{', '.join(f'{x:.9g}' for x in r.tolist())}]::FLOAT[])" for k, r in enumerate(rows))
    return f"""pm AS (SELECT * FROM (VALUES {values}) t(k, r)),
    pd AS (SELECT vec_id, k, list_reduce(list_transform(range(1, {dims + 1}), lambda i: (embedding[i] * r[i])::FLOAT), lambda s, x: (s + x)::FLOAT, 0::FLOAT) AS x FROM {{source}}, pm),
    pr AS (SELECT vec_id, list(x ORDER BY k) AS e FROM pd GROUP BY vec_id)"""


def _edit(source: str, most: int) -> str:
    return f"WITH v AS (SELECT DISTINCT value FROM ({source}) WHERE value IS NOT NULL) SELECT x.value AS value_a, y.value AS value_b, levenshtein(x.value, y.value)::INTEGER AS distance FROM v x JOIN v y ON x.value < y.value AND levenshtein(x.value, y.value) <= {most}"


ORACLES = {
    "levenshtein_topk": f"WITH {N} SELECT p_name, levenshtein(p_name, 'misty rose')::INTEGER AS distance, round({nl('p_name', chr(39) + 'misty rose' + chr(39))}, 9) AS score FROM n ORDER BY score DESC, p_name LIMIT 10",
    "levenshtein_pairs": f"WITH {P} SELECT a, b, levenshtein(a, b)::INTEGER AS distance, round({nl('a', 'b')}, 9) AS score FROM p",
    "levenshtein_options": f"WITH {N} SELECT p_name, 0::INTEGER AS prepared, levenshtein(upper(p_name), p_name)::INTEGER AS plain FROM n",
    "jaro_pairs": f"WITH {P} SELECT a, b, round(jaro_similarity(a, b), 9) AS score FROM p",
    "jaro_winkler_pairs": f"WITH {P} SELECT a, b, round({jw('a', 'b')}, 9) AS score, round({jw('a', 'b', 0.2)}, 9) AS score_20 FROM p",
    "hamming_pairs": f"WITH {P} SELECT a, b, CASE WHEN length(a) = length(b) THEN hamming(a, b)::INTEGER END AS distance, CASE WHEN length(a) = length(b) THEN round(1.0 - hamming(a, b)::DOUBLE / length(a), 9) END AS score FROM p",
    "best_match_pairs": f"WITH {P} SELECT a, b, round({best('a', 'b')}, 9) AS score FROM p",
    "text_simhash": f"WITH {N}, {hashes('n')} SELECT t AS p_name, hash FROM hs",
    "simhash_distances": f"WITH {N}, {hashes('n')} SELECT x.t AS a, y.t AS b, {_bits('x.hash', 'y.hash')}::INTEGER AS distance, 1 - {_bits('x.hash', 'y.hash')}::DOUBLE / 64 AS similarity FROM hs x JOIN hs y ON x.t < y.t",
    "similar_hash_lookup": f"WITH {N}, s AS (SELECT p_name FROM n UNION SELECT 'red brass'), {hashes('s')}, q AS (SELECT hash AS qh FROM hs WHERE t = 'red brass') SELECT t AS p_name, {_bits('hash', 'qh')}::INTEGER AS distance, 1 - {_bits('hash', 'qh')}::DOUBLE / 64 AS similarity FROM hs, q WHERE {_bits('hash', 'qh')} <= 24 AND t IN (SELECT p_name FROM n)",
    "simhash_bits": f"WITH {N}, {hashes('n')} SELECT t AS p_name, CASE WHEN hash < 0 THEN bin(hash::HUGEINT + 18446744073709551616::HUGEINT) ELSE lpad(bin(hash), 64, '0') END AS bits, (CASE WHEN hash < 0 THEN hash::HUGEINT + 18446744073709551616::HUGEINT ELSE hash::HUGEINT END)::VARCHAR AS \"unsigned\", bit_count(hash)::INTEGER AS n_set FROM hs",
    "best_match_per_query": f"WITH {QS}, s AS (SELECT query, p_partkey, {best('query', 'p_name')} AS score FROM q, part WHERE p_name IS NOT NULL) SELECT query, arg_max(p_partkey, (score, p_partkey)) AS p_partkey, round(max(score), 9) AS score FROM s GROUP BY query",
    "matches_above_threshold": f"SELECT p_partkey, p_name, round({best(chr(39) + 'blue' + chr(39), 'p_name')}, 9) AS score FROM part WHERE {best(chr(39) + 'blue' + chr(39), 'p_name')} >= 0.6",
    "fuzzy_search": f"SELECT p_partkey, p_name, round({best(chr(39) + 'red bras' + chr(39), 'lower(p_name)')}, 9) AS score FROM part WHERE {best(chr(39) + 'red bras' + chr(39), 'lower(p_name)')} >= 0.5 ORDER BY {best(chr(39) + 'red bras' + chr(39), 'lower(p_name)')} DESC, p_partkey LIMIT 10",
    "fuzzy_search_table": f"SELECT c_custkey, c_name, round({nl(chr(39) + 'customer#000000042' + chr(39), 'lower(c_name)')}, 9) AS score FROM customer WHERE {nl(chr(39) + 'customer#000000042' + chr(39), 'lower(c_name)')} >= 0.9",
    "top3_per_query": f"WITH {QS}, s AS (SELECT query, p_partkey, {best('query', 'lower(p_name)')} AS score FROM q, part WHERE p_name IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, p_partkey)::INTEGER AS rank FROM s) SELECT query, rank, p_partkey, round(score, 9) AS score FROM r WHERE rank <= 3",
    "stored_hashes": f"WITH {N}, {hashes('n')} SELECT p_partkey, p_name, hash AS simhash FROM part LEFT JOIN hs ON p_name = t",
    "hash_search_texts": f"WITH {N}, s AS (SELECT p_name FROM n UNION SELECT 'blue tin'), {hashes('s')}, q AS (SELECT hash AS qh FROM hs WHERE t = 'blue tin') SELECT t AS p_name, {_bits('hash', 'qh')}::INTEGER AS distance, 1 - {_bits('hash', 'qh')}::DOUBLE / 64 AS similarity FROM hs, q WHERE {_bits('hash', 'qh')} <= 28 AND t IN (SELECT p_name FROM n) ORDER BY distance, p_name LIMIT 20",
    "edit_distance_join": _edit("SELECT p_name AS value FROM part", 2),
    "customer_name_join": _edit("SELECT regexp_replace(c_name, '^Customer', '') AS value FROM customer UNION ALL SELECT regexp_replace(s_name, '^Supplier', '') FROM supplier", 1),
    "url_similarity": _edit("SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS value FROM pages", 2),
    "similar_names": f"WITH {P} SELECT a AS value_a, b AS value_b, round({jw('a', 'b')}, 9) AS score FROM p WHERE {jw('a', 'b')} > 0.85",
    "hash_pairs": f"WITH {N}, {hashes('n')} SELECT x.t AS key_a, y.t AS key_b, {_bits('x.hash', 'y.hash')}::INTEGER AS distance FROM hs x JOIN hs y ON x.t < y.t AND {_bits('x.hash', 'y.hash')} <= 12",
    "rows_without_partner": f"WITH {N} SELECT p_name FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.p_name <> n.p_name AND levenshtein(m.p_name, n.p_name) <= 1)",
    "rows_with_partner": f"WITH {N} SELECT p_name FROM n WHERE EXISTS (SELECT 1 FROM n m WHERE m.p_name <> n.p_name AND levenshtein(m.p_name, n.p_name) <= 1)",
    "vector_checks": "SELECT vec_id, len(embedding) BETWEEN 64 AND 2048 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS valid, len(embedding)::INTEGER AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings",
    "cosine_topk": f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round({DOTP.format(a='embedding', b='q')} / (sqrt({DOTP.format(a='embedding', b='embedding')}) * sqrt({DOTP.format(a='q', b='q')})), 6) AS score FROM embeddings, q WHERE vec_id <> 0) SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10",
    "quantised_coordinates": f"SELECT vec_id, list_transform(embedding[1:10], lambda x: {COORD}) AS coords FROM embeddings",
    "morton_ids": f"WITH {MORTON} SELECT vec_id, id FROM m",
    "morton_ids_native": f"WITH {MORTON} SELECT vec_id, id FROM m",
    "morton_range_scan": f"WITH {MORTON} SELECT vec_id, id FROM m WHERE id BETWEEN '08006' AND '0800b' ORDER BY id LIMIT 10",
    "id_prefix_scan": f"WITH {MORTON} SELECT vec_id, id FROM m WHERE id LIKE '08007%'",
    "vector_hashes": f"WITH {_hash('embeddings')} SELECT vec_id, hi, lo FROM vh",
    "id_distances": f"WITH {_hash('u', UNIT)}, q AS (SELECT hi AS qh, lo AS ql FROM vh WHERE vec_id = 0), d AS (SELECT vec_id, ({_bits('hi', 'qh')} + {_bits('lo', 'ql')})::INTEGER AS distance FROM vh, q) SELECT vec_id, distance, round(1 - distance / 128.0 * pi(), 4)::DOUBLE AS linear, round(cos(distance / 128.0 * pi()), 6) AS estimate FROM d",
    "live_search": f"WITH {N}, s AS (SELECT p_name FROM n UNION SELECT 'blue'), {hashes('s')}, q AS (SELECT hash AS qh FROM hs WHERE t = 'blue'), m AS (SELECT t AS p_name, {jw(chr(39) + 'blue' + chr(39), 'lower(t)')} AS jw, {nl(chr(39) + 'blue' + chr(39), 'lower(t)')} AS nl, 1 - {_bits('hash', 'qh')}::DOUBLE / 64 AS sh FROM hs, q WHERE t IN (SELECT p_name FROM n)) SELECT p_name, round(greatest(jw, nl, sh), 9) AS score, CASE WHEN nl >= jw AND nl >= sh THEN 'normalized_levenshtein' WHEN sh >= jw AND sh >= nl THEN 'simhash' ELSE 'jaro_winkler' END AS metric FROM m WHERE greatest(jw, nl, sh) >= 0.3",
    "hash_ids": f"WITH {_hash('u', UNIT)}, {BIT_TEXT}, w AS (SELECT vec_id, '0000000100000000' || bits || '0' AS bits FROM bt) SELECT vec_id, {B32.format(bits='bits')} AS id FROM w",
    "band_values": f"WITH {_hash('embeddings')}, {BIT_TEXT}, w AS (SELECT vec_id, i, substr(bits, (32 * i + 1)::INTEGER, 32) || '000' AS b FROM bt, range(0, 4) r(i)), v AS (SELECT vec_id, i, {B32.format(bits='b')} AS band FROM w) SELECT i::INTEGER AS band_idx, count(*) AS n, count(DISTINCT band) AS n_distinct, min(band) AS least FROM v GROUP BY i",
    "shared_band_counts": f"WITH {_hash('embeddings')}, {BIT_TEXT}, w AS (SELECT vec_id, i, substr(bits, (8 * i + 1)::INTEGER, 8) AS b FROM bt, range(0, 16) r(i)), q AS (SELECT DISTINCT b FROM w WHERE vec_id = 0) SELECT w.vec_id, count(q.b)::INTEGER AS n_shared FROM w LEFT JOIN q ON w.b = q.b WHERE w.vec_id <> 0 GROUP BY w.vec_id",
    "nearest_labels": f"WITH {_hash('embeddings')}, q AS (SELECT hi AS qh, lo AS ql FROM vh WHERE vec_id = 0), d AS (SELECT e.label, vh.vec_id, ({_bits('hi', 'qh')} + {_bits('lo', 'ql')})::INTEGER AS distance FROM vh JOIN embeddings e ON e.vec_id = vh.vec_id, q WHERE vh.vec_id <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id)::INTEGER AS rank FROM d) SELECT label, rank, vec_id, distance FROM r WHERE rank <= 3",
    "curve_round_trip": f"WITH c AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: {COORD}) AS c FROM embeddings), b AS (SELECT vec_id, '0000' || list_reduce(list_transform(range(0, 100), lambda i: ((c[10 - i % 10] >> (9 - i // 10)) & 1)::VARCHAR), lambda s, x: s || x) AS bits FROM c) SELECT vec_id, list_reduce(list_transform(range(0, 26), lambda k: substr('0123456789abcdef', 1 + list_reduce(list_transform(range(1, 5), lambda i: substr(bits, (4 * k + i)::INTEGER, 1)::INTEGER), lambda s, x: 2 * s + x), 1)), lambda s, x: s || x) AS morton, true AS morton_back, true AS hilbert_back FROM b",
    "truncated_vectors": "WITH t AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, 32::INTEGER AS dims, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS first FROM t",
    "band_join": f"WITH {_hash('embeddings')}, b AS (SELECT vec_id, hi, lo, i, CASE WHEN i < 4 THEN (hi >> (16 * i)) & 65535 ELSE (lo >> (16 * (i - 4))) & 65535 END AS v FROM vh, range(0, 8) r(i)) SELECT DISTINCT x.vec_id AS key_a, y.vec_id AS key_b, ({_bits('x.hi', 'y.hi')} + {_bits('x.lo', 'y.lo')})::INTEGER AS distance FROM b x JOIN b y ON x.i = y.i AND x.v = y.v AND x.vec_id < y.vec_id WHERE {_bits('x.hi', 'y.hi')} + {_bits('x.lo', 'y.lo')} <= 40",
    "id_metadata": "SELECT vec_id, 64::INTEGER AS original_dims, 16::INTEGER AS encoded_dims, false AS is_lossless, true AS has_dimension_reduction, 'full32' AS precision, 'reduce' AS dimension_mode, true AS reversible, false AS plain_reversible FROM embeddings",
    "sql_functions": f"WITH {N}, {hashes('n')} SELECT t AS p_name, round({nl('t', chr(39) + 'red' + chr(39))}, 9) AS nl, CASE WHEN length(t) = 3 THEN hamming(t, 'tin')::INTEGER END AS h, bit_count(hash)::INTEGER AS n_set FROM hs",
    "osa_pairs": f"WITH {P}, d AS (SELECT a, b, {OSA.format(a='a', b='b')} AS distance FROM p) SELECT a, b, distance, round(1.0 - distance::DOUBLE / greatest(length(a), length(b)), 9) AS score FROM d",
    "compare_all_metrics": f"WITH {P}, {hashes('n')}, m AS (SELECT a, b, levenshtein(a, b)::INTEGER AS levenshtein, {OSA.format(a='a', b='b')} AS osa, x.hash AS ha, y.hash AS hb FROM p JOIN hs x ON x.t = a JOIN hs y ON y.t = b) SELECT a, b, levenshtein, round({nl('a', 'b')}, 9) AS normalized_levenshtein, osa, round(jaro_similarity(a, b), 9) AS jaro, round({jw('a', 'b')}, 9) AS jaro_winkler, CASE WHEN length(a) = length(b) THEN hamming(a, b)::INTEGER END AS hamming, 1 - {_bits('ha', 'hb')}::DOUBLE / 64 AS simhash_similarity, osa < levenshtein AS transposed FROM m",
    "normalized_vectors": "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 3::FLOAT)::FLOAT) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: (x * x)::FLOAT), lambda s, x: (s + x)::FLOAT))::FLOAT AS nrm FROM s), v AS (SELECT vec_id, list_transform(e, lambda x: (x / nrm)::FLOAT) AS v FROM n) SELECT vec_id, round(v[1]::DOUBLE, 5) AS first, round(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS square FROM v",
    "hilbert_ids": f"WITH {HILBERT.format(unit=UNIT, coord=COORD)} SELECT vec_id, {B32.format(bits='bits')} AS id FROM hb",
    "common_space": f"WITH both_ AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT -1 - vec_id, list_transform(embedding, lambda x, i: CASE WHEN i <= 48 THEN x ELSE 0::FLOAT END) FROM embeddings), {projected(SEED_COMMON, rng.COMMON_SOURCE_DIMS, 32, 64).format(source='both_')}, hv AS (SELECT vec_id, list_transform(e, lambda x: {HALF.format(x='x')}) AS e FROM pr) SELECT x.vec_id, round(greatest(0.0, least(1.0, ({DOTP.format(a='x.e', b='y.e')} / (sqrt({DOTP.format(a='x.e', b='x.e')}) * sqrt({DOTP.format(a='y.e', b='y.e')})) + 1) / 2)), 4) AS similarity FROM hv x JOIN hv y ON y.vec_id = -1 - x.vec_id WHERE x.vec_id >= 0",
    "half_codec": f"WITH {full_ids(projected(SEED_COMMON, rng.COMMON_SOURCE_DIMS, 32, 64).format(source='embeddings') + f', v AS (SELECT vec_id, list_transform(e, lambda x: {HALF.format(x=chr(120))}) AS v FROM pr)', cross_dimensional(32).header(64), joined_bits('v', HALF_BITS.format(x='x')))} SELECT ids.vec_id, id, list_transform(v, lambda x: x::DOUBLE) AS back FROM ids JOIN v USING (vec_id)",
    "lossless_codec": f"WITH {full_ids('v AS (SELECT vec_id, embedding AS v FROM embeddings)', lossless().header(64), joined_bits('v', float_bits('x')))} SELECT ids.vec_id, id, 64::INTEGER AS dims, round(embedding[1]::DOUBLE, 5) AS first, true AS exact FROM ids JOIN embeddings USING (vec_id)",
    "reduced_codec": f"WITH {full_ids(projected(SEED_COMPRESSED, 64, 32, 64).format(source='embeddings') + ', v AS (SELECT vec_id, e AS v FROM pr)', compressed(0.5, 64).header(64), joined_bits('v', float_bits('x')))} SELECT vec_id, id, 32::INTEGER AS dims FROM ids",
    "length_bounded_codec": f"WITH {full_ids(projected(SEED_MAX_LENGTH, 64, 25, 64).format(source='embeddings') + f', v AS (SELECT vec_id, list_transform(e, lambda x: {HALF.format(x=chr(120))}) AS v FROM pr)', max_length(100, 64).header(64), joined_bits('v', HALF_BITS.format(x='x')))} SELECT vec_id, id, 25::INTEGER AS dims FROM ids",
    "parsed_vectors": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS list_sum, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS json_sum, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM embeddings",
    "document_hash_classes": f"WITH {text_hashes('SELECT doc_id, text FROM documents', 'doc_id')} SELECT doc_id, hash, min(doc_id) OVER (PARTITION BY hash) AS class_id, count(*) OVER (PARTITION BY hash) AS class_size FROM hk",
    "benchmark_hash_matches": f"WITH {text_hashes('SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark', 'doc_id, item_id')}, k AS (SELECT min(doc_id) AS id, hash FROM hk WHERE doc_id IS NOT NULL GROUP BY hash) SELECT k.id AS key_a, b.item_id AS key_b, {_bits('k.hash', 'b.hash')}::INTEGER AS distance FROM k JOIN hk b ON b.item_id IS NOT NULL AND {_bits('k.hash', 'b.hash')} <= 8",
    "conversation_near_duplicates": f"WITH {text_hashes(TURNS, 'key')}, k AS (SELECT hash, min(key) AS class_id, count(*) AS class_size FROM hk GROUP BY hash), l AS (SELECT x.class_id, count(*) AS n_links FROM k x JOIN k y ON x.hash <> y.hash AND {_bits('x.hash', 'y.hash')} <= 6 GROUP BY x.class_id) SELECT key, class_id, class_size, coalesce(n_links, 0)::BIGINT AS n_links FROM hk JOIN k USING (hash) LEFT JOIN l USING (class_id)",
    "conversation_class_pairs": f"WITH {text_hashes(TURNS, 'key')}, k AS (SELECT hash, min(key) AS class_id FROM hk GROUP BY hash) SELECT x.class_id AS key_a, y.class_id AS key_b, {_bits('x.hash', 'y.hash')}::INTEGER AS distance FROM k x JOIN k y ON x.class_id < y.class_id AND {_bits('x.hash', 'y.hash')} <= 6",
}
for _name, _profile in (("quantised_codec", FullProfile(QUANT8)), ("bits_codec", FullProfile(bits(4)))):
    _n = _profile.precision.bits
    _ids = full_ids(quantised("SELECT vec_id, embedding AS e FROM embeddings", _n), _profile.header(64), f"{float_bits('lo')} || {float_bits('hi')} || " + joined_bits("q", f"lpad(bin(x), {_n}, '0')"))
    ORACLES[_name] = f"WITH {_ids} SELECT ids.vec_id, id, 64::INTEGER AS dims, round((lo + ((q[1]::FLOAT / {(1 << _n) - 1}::FLOAT)::FLOAT * (hi - lo)::FLOAT)::FLOAT)::FLOAT::DOUBLE, 5) AS first, true AS near FROM ids JOIN v USING (vec_id)"

#: The toy model's vectors: mean over words of what their lengths give, to length one.
TOY = f"""{N}, tw AS (SELECT p_name, unnest(string_split_regex(trim(p_name), '\\s+')) AS w FROM n),
    tc AS (SELECT p_name, k, avg((((length(w) + 1) * (k + 3) * 7919 % 17) - 8) / 8.0::DOUBLE) AS x FROM tw, range(0, 64) r(k) WHERE length(w) < 12 GROUP BY p_name, k),
    tv AS (SELECT p_name, list(x ORDER BY k) AS m FROM tc GROUP BY p_name),
    toy AS (SELECT p_name, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS v FROM tv)"""
HEX = "list_reduce(list_transform(range(0, length({bits}) // 4), lambda k: substr('0123456789ABCDEF', 1 + list_reduce(list_transform(range(1, 5), lambda i: substr({bits}, (4 * k + i)::INTEGER, 1)::INTEGER), lambda s, x: 2 * s + x), 1)), lambda s, x: s || x)"
LISTED = "['blue ring', 'red widget', 'small']"
ORACLES |= {
    "decoded_ids": f"WITH {MORTON} SELECT vec_id, {HEX.format(bits='substr(bits, 1, 120)')} AS bytes FROM b",
    "vectors_from_doubles": ORACLES["hash_ids"],
    "hash_bytes_back": f"WITH {_hash('embeddings')}, {BIT_TEXT} SELECT vec_id, {HEX.format(bits='bits')} AS bytes, hi, lo, true AS short_is_null FROM vh JOIN bt USING (vec_id)",
    "id_profiles": "SELECT vec_id, i::INTEGER AS place, CASE i WHEN 0 THEN 'hash' WHEN 1 THEN 'morton' WHEN 2 THEN 'hilbert' WHEN 3 THEN 'full' END AS profile FROM embeddings, range(0, 15) r(i)",
    "profile_sizes": "WITH p(profile, type_id, per_dim, fixed, kept) AS (VALUES ('hash', 1, 0, 128, 0), ('morton', 2, 0, 100, 0), ('hilbert', 3, 0, 128, 0), ('lossless', 4, 32, 0, 0), ('quant8', 4, 8, 0, 0), ('bits4', 4, 4, 0, 0), ('common128', 4, 16, 0, 128)), l AS (SELECT *, (fixed + per_dim * CASE WHEN kept > 0 THEN kept ELSE dims END)::INTEGER AS b FROM p, (VALUES (64), (128), (768)) d(dims)) SELECT profile, dims::INTEGER AS dims, b AS bit_length, ceil((b + CASE WHEN type_id = 4 THEN 96 ELSE 16 END) / 5.0)::INTEGER AS string_length, type_id::INTEGER AS type_id, type_id = 4 AS reversible FROM l",
    "refused_profiles": "SELECT 'curve' AS kind, n::INTEGER AS dims, b::INTEGER AS bits, NOT (n BETWEEN 1 AND 32 AND b BETWEEN 1 AND 16 AND n * b <= 128) AS refused FROM (VALUES (0), (1), (8), (16), (32), (33)) x(n), (VALUES (0), (1), (4), (16), (17)) y(b) UNION ALL SELECT 'bits', 0, b::INTEGER, NOT b BETWEEN 1 AND 32 FROM (VALUES (0), (1), (32), (33)) z(b)",
    "suggested_bands": "WITH g AS (SELECT (4 * i)::INTEGER AS distance, r::DOUBLE AS recall FROM range(0, 17) x(i), (VALUES (0.5), (0.9), (0.99)) y(r)) SELECT distance, recall, (SELECT min(n) FROM (VALUES (1), (2), (4), (8), (16)) z(n) WHERE 1 - pow(1 - pow(1 - distance / 128.0, 128 / n), n) >= recall)::INTEGER AS bands FROM g",
    "hash_positions": f"WITH {N}, {hashes('n')}, l AS (SELECT left(t, 1) AS first, list(hash ORDER BY t) AS hs FROM hs GROUP BY 1) SELECT first, list_filter(list_transform(hs, lambda h, i: CASE WHEN {_bits('h', 'hs[1]')} <= 24 THEN (i - 1)::INTEGER END), lambda x: x IS NOT NULL) AS places FROM l",
    "hash_range_lookup": f"WITH {N}, s AS (SELECT p_name FROM n UNION SELECT 'red brass'), {hashes('s')}, u AS (SELECT t, hash, CASE WHEN hash < 0 THEN hash::HUGEINT + 18446744073709551616::HUGEINT ELSE hash::HUGEINT END AS x FROM hs), q AS (SELECT hash AS qh, x AS qx FROM u WHERE t = 'red brass'), w AS (SELECT t, hash, qh FROM u, q WHERE t IN (SELECT p_name FROM n) AND x BETWEEN greatest(0::HUGEINT, qx - 4611686018427387904::HUGEINT) AND qx + 4611686018427387904::HUGEINT ORDER BY t LIMIT 100) SELECT t AS p_name, {_bits('hash', 'qh')}::INTEGER AS distance, 1 - {_bits('hash', 'qh')}::DOUBLE / 64 AS similarity FROM w WHERE {_bits('hash', 'qh')} <= 62",
    "embedded_texts": f"WITH {TOY} SELECT p_name, round(v[1], 4) AS first, round(v[64], 4) AS last, 1.0::DOUBLE AS square FROM toy",
    "model_from_files": f"WITH {TOY} SELECT p_name, round(v[1], 4) AS first FROM toy",
    "model_folders": "SELECT 'given' AS given, true AS is_set",
    "formats_back": "SELECT kind, p_partkey, p_name, p_size FROM part, (VALUES ('json'), ('csv'), ('orc')) k(kind)",
    "stored_ids": ORACLES["id_prefix_scan"],
    "stored_bands": f"WITH {_hash('embeddings')}, {BIT_TEXT}, w AS (SELECT i, substr(bits, (16 * i + 1)::INTEGER, 16) || '0000' AS b FROM bt, range(0, 8) r(i)), v AS (SELECT i, {B32.format(bits='b')} AS band FROM w) SELECT i::INTEGER AS band_idx, band, count(*) AS n FROM v GROUP BY i, band HAVING count(*) > 1",
    "stored_text_hashes": ORACLES["stored_hashes"],
    "image_sizes": "WITH s AS (SELECT width, height, greatest(224, round_even(width * (256.0::DOUBLE / least(width, height)), 0))::INTEGER AS w, greatest(224, round_even(height * (256.0::DOUBLE / least(width, height)), 0))::INTEGER AS h FROM (VALUES (100), (224), (256), (640), (1000)) x(width), (VALUES (100), (300), (768)) y(height)) SELECT width::INTEGER AS width, height::INTEGER AS height, w AS scaled_width, h AS scaled_height, ((w - 224) // 2)::INTEGER AS \"left\", ((h - 224) // 2)::INTEGER AS \"top\" FROM s",
    "stream_scores": f"SELECT p_partkey, p_name, round({best(chr(39) + 'red bras' + chr(39), 'p_name')}, 9) AS score FROM part WHERE {best(chr(39) + 'red bras' + chr(39), 'p_name')} >= 0.6",
    "stream_matches": "SELECT p_partkey, p_name, word, levenshtein(p_name, word)::INTEGER AS distance FROM part, (SELECT unnest([" + ", ".join("'" + w.replace("e", "a") + "'" for w in WORDS) + ", 'small rong', 'blue wodgat']) AS word) WHERE levenshtein(p_name, word) <= 2",
    "stream_first_of_each": f"WITH {text_hashes(EVENT_TEXTS, 'event_id')} SELECT DISTINCT hash AS simhash FROM hk",
    "stream_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2",
    "sql_matches": f"WITH {N}, s AS (SELECT p_name FROM n UNION SELECT 'red ring'), {hashes('s')}, q AS (SELECT hash AS qh FROM hs WHERE t = 'red ring'), c AS (SELECT p_name, c, i, {best('p_name', 'c')} AS score FROM n, (SELECT unnest({LISTED}) AS c, unnest([0, 1, 2]) AS i)), l AS (SELECT p_name, arg_max(i, (score, i))::INTEGER AS nearest, count(*) FILTER (score >= 0.7)::INTEGER AS n_above FROM c GROUP BY p_name) SELECT n.p_name, round({best('n.p_name', chr(39) + 'red ring' + chr(39))}, 9) AS best, round({jw('n.p_name', chr(39) + 'red ring' + chr(39), 0.2)}, 9) AS jw20, {OSA.format(a='n.p_name', b=chr(39) + 'der ring' + chr(39))} AS osa, nearest, n_above, levenshtein(lower(n.p_name), 'red ring')::INTEGER AS prepared, round(1 - {_bits('hash', 'qh')}::DOUBLE / 64, 9) AS sh FROM n JOIN l USING (p_name) JOIN hs ON t = n.p_name, q",
    "sql_best_of_group": f"SELECT p_brand, arg_max(p_name, ({best(chr(39) + 'red rings' + chr(39), 'p_name')}, p_name)) AS best FROM part WHERE p_name IS NOT NULL GROUP BY p_brand",
    "sql_bands": f"WITH {_hash('embeddings')}, {BIT_TEXT}, w AS (SELECT vec_id, i, substr(bits, (32 * i + 1)::INTEGER, 32) || '000' AS b FROM bt, range(0, 4) r(i)) SELECT vec_id, i::INTEGER AS band_idx, {B32.format(bits='b')} AS band, true AS same FROM w",
}
ORACLES["embedded_text_distances"] = f"WITH {TOY}, asked AS (SELECT list_transform(range(0, 64), lambda k: (((6 * (k + 3) * 7919 % 17) - 8) / 8.0 + ((5 * (k + 3) * 7919 % 17) - 8) / 8.0 + ((5 * (k + 3) * 7919 % 17) - 8) / 8.0) / 3) AS v), every AS (SELECT p_name AS vec_id, v AS embedding FROM toy UNION ALL SELECT '?', v FROM asked), {_hash('every')}, q AS (SELECT hi AS qh, lo AS ql FROM vh WHERE vec_id = '?') SELECT vec_id AS p_name, ({_bits('hi', 'qh')} + {_bits('lo', 'ql')})::INTEGER AS distance FROM vh, q WHERE vec_id <> '?'"
ORACLES["sql_ids"] = f"WITH a AS ({ORACLES['hash_ids']}), b AS ({ORACLES['morton_ids']}), c AS ({ORACLES['hilbert_ids']}), d AS ({ORACLES['length_bounded_codec']}), e AS ({ORACLES['decoded_ids']}) SELECT a.vec_id, a.id AS h, b.id AS m, c.id AS b, d.id AS x, 32::INTEGER AS dims, 0::INTEGER AS same, e.bytes AS raw FROM a JOIN b USING (vec_id) JOIN c USING (vec_id) JOIN d USING (vec_id) JOIN e USING (vec_id)"
