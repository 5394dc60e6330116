"""SQL twins, for DuckDB, of the operators' queries that SQL can express."""

from __future__ import annotations

from chunkweave.llm.license_scan import BASE, MORE
from chunkweave.llm.url_filter import RULES, TRACKING

WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def url_filter() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r[1]}{r[2]}'" for r in rules)
    says = " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in rules)
    words = lambda t: f"regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+')"
    kept = f"list_sort(list_filter(string_split(regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)^[^?]*\\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^({'|'.join(TRACKING)})(=|$)')))"
    return f"""WITH known AS (SELECT doc_id, max(toxic) AS bad FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
seen AS (SELECT bad, unnest(list_distinct({words("text")})) AS w FROM documents JOIN known USING (doc_id)),
counts AS (SELECT w, count(*) FILTER (WHERE bad = 1) AS t, count(*) FILTER (WHERE bad = 0) AS n FROM seen WHERE w <> '' GROUP BY w),
marks AS (SELECT coalesce(list(w), []) AS marks FROM counts WHERE t > 0 AND t >= 19 * n AND 8 * t >= (SELECT count(*) FROM documents JOIN known USING (doc_id) WHERE bad = 1)),
p AS (SELECT *, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, {kept} AS kept FROM pages),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key FROM p),
l AS (SELECT DISTINCT key FROM c, marks WHERE list_has_any({words("html")}, marks) AND key IS NOT NULL),
j AS (SELECT c.*, l.key IS NOT NULL AS listed FROM c LEFT JOIN l USING (key))
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {says} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM j"""


TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (s) WHERE doc_id > m),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept k USING (doc_id)"""


def license_scan() -> str:
    strings = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    places = []
    starts = lambda p: f"list_filter(range(1, len(w) - {len(p)} + 2), lambda i: w[i] = '{p[0]}' AND w[i:i+{len(p) - 1}] = {strings(p)})"
    for k, t in enumerate(BASE + MORE):
        whole = f"{t.before} {t.phrase} {t.after}".split()
        at = f"s - {len(t.before.split())} + j"
        hits = f"len(list_filter(range({len(whole)}), lambda j: {at} > 0 AND w[{at}] = ({strings(whole)})[j + 1]))"
        fits = "".join([f" AND len({starts(x.split())}) {test}" for x, test in ((t.needs, "> 0"), (t.bars, "= 0")) if x])
        held = f"SELECT * FROM d WHERE list_has_all(w, {strings(t.phrase.split())})"  # few documents have all words of a phrase
        found = f"SELECT doc_id, w, unnest({starts(t.phrase.split())}) AS s FROM ({held}) WHERE true{fits}"
        places.append(f"SELECT doc_id, '{t.label}' AS label, {k < len(BASE)} AS base, s - 1 AS start, {hits} / {len(whole)} AS share FROM ({found})")
    return f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
places AS ({" UNION ALL ".join(places)})
SELECT d.doc_id, len(d.w) AS n_words, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
 FROM d LEFT JOIN places USING (doc_id) GROUP BY d.doc_id, d.w"""


#: The CRC-32 of a decimal id comes from the usual table of 256 remainders, which a recursive query makes.
TRIE = """WITH RECURSIVE bits AS (SELECT range AS b, range AS r, 0 AS k FROM range(256) UNION ALL
 SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(r ORDER BY b) AS tab FROM bits WHERE k = 8),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS i, {'r': r, 'x': x} AS m
 FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
held AS (SELECT conv_id, list(m ORDER BY i) AS ms, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
own AS (SELECT held.*, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: xor(a >> 8, tab[(xor(a, c) & 255) + 1])) AS crc FROM held, tab),
built AS (SELECT o.conv_id, list_concat(coalesce(b.ms, [])[:xor(o.crc, 4294967295) % 6], o.ms[xor(o.crc, 4294967295) % 6 + 1:]) AS ms FROM own o LEFT JOIN own b ON b.conv_id = o.base),
seen AS (SELECT conv_id, d, ms[:d] AS node, d = len(ms) AS last FROM (SELECT conv_id, ms, unnest(range(len(ms) + 1)) AS d FROM built)),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM seen GROUP BY node, d),
kids AS (SELECT node[:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(node[d].x) END AS saved FROM nodes n LEFT JOIN kids k USING (node, d)),
subtrees AS (SELECT top, d, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM
 (SELECT node[:u] AS top, u AS d, n_children, saved FROM (SELECT *, unnest(range(d + 1)) AS u FROM full_nodes)) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
 FROM full_nodes n JOIN subtrees s ON s.top = n.node AND s.d = n.d LEFT JOIN nodes p ON p.node = n.node[:n.d - 1] AND p.d = n.d - 1"""


#: Blobs count bytes. A removed run goes on while the next window starts within 50 bytes.
SUFFIX = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT r, doc_id, i, b[i:i + 49] AS s FROM (SELECT r, doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 50, true) AS new FROM win JOIN least USING (s) WHERE doc_id > m),
numbered AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM gone),
spans AS (SELECT r, k, min(i) AS a, max(i) + 50 AS z FROM numbered GROUP BY ALL),
cuts AS (SELECT r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list_concat([1], list(z ORDER BY a)) AS froms, list(a ORDER BY a) AS tos FROM spans GROUP BY r),
kept AS (SELECT r, sha256(unhex(string_agg(hex(b[f:t - 1]), '' ORDER BY f))) AS sha FROM
 (SELECT d.r, d.b, unnest(froms) AS f, unnest(list_concat(tos, [octet_length(b) + 1])) AS t FROM cuts JOIN d USING (r)) WHERE t > f GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 CASE WHEN n_spans IS NULL THEN sha256(b) ELSE coalesce(sha, sha256('')) END AS kept_sha256 FROM d LEFT JOIN cuts USING (r) LEFT JOIN kept USING (r)"""


COLLOCATIONS = """WITH pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM
 (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, ws[i:i + k - 1] AS w FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM pieces))) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, w, f AS a FROM f WHERE len(w) > 1),
cuts AS (SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM c),
scored AS (SELECT x.lang, x.w, x.a, x.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * x.a) // (l.f + r.f))::BIGINT AS score FROM cuts x
 JOIN f l ON l.lang = x.lang AND l.w = x.w[:x.k] JOIN f r ON r.lang = x.lang AND r.w = x.w[x.k + 1:]),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
parts AS (SELECT lang, a, w[i:i + k - 1] AS w FROM (SELECT lang, a, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest(range(2, len(w))) AS k FROM c))),
longer AS (SELECT lang, w, max(a) AS most FROM parts GROUP BY ALL),
kept AS (SELECT s.lang, array_to_string(s.w, ' ') AS phrase, s.a, s.l, s.r, s.score FROM least s LEFT JOIN longer g USING (lang, w) WHERE g.most IS NULL OR 100 * g.most < 80 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter(),
        "op8_cover_tree_topk": TOP_K,
        "op9_license_scan": license_scan(),
        "op10_substring_dedup": SUBSTRING,
        "op11_conversation_trie": TRIE,
        "op12_suffix_dedup": SUFFIX,
        "op13_phrase_collocations": COLLOCATIONS,
    }
