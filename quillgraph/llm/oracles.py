"""DuckDB SQL for the operators that SQL can express; doc_id and item_id are unique in the tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substring(h, 2 * i - 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS i FROM d WHERE len(h) >= 200)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS k FROM again),
runs AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN k - 1 = before THEN 0 ELSE 1 END) AS n_spans FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone) GROUP BY doc_id),
kept AS (SELECT b.doc_id, string_agg(b.x, '' ORDER BY b.k) AS h FROM (SELECT doc_id, k, substring(h, 2 * k - 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS k FROM d JOIN runs USING (doc_id))) b ANTI JOIN gone g ON g.doc_id = b.doc_id AND g.k = b.k GROUP BY b.doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN runs.doc_id IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM again),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY a.k) AS t FROM word a ANTI JOIN gone g ON g.doc_id = a.doc_id AND g.k = a.k GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS root, doc_id AS node FROM n UNION SELECT root, y FROM reach JOIN edge ON x = node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(root) AS c FROM reach GROUP BY node) m USING (doc_id)
"""

OP10 = rf"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered JOIN (SELECT DISTINCT n FROM b) ON len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _crc_table() -> str:
    """A query of one row: the 256 words of crc32's table as a list t."""
    step = "SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({})"
    rows = "SELECT i, i AS c FROM range(256) r(i)"
    for _ in range(8):
        rows = step.format(rows)
    return f"SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM ({rows})"


def _crc(text: str) -> str:
    """crc32 of a string's UTF-8 bytes, where crc.t is the table."""
    code = f"list_transform(range(1, CAST(octet_length(encode({text})) AS BIGINT) + 1), lambda i: CAST(('0x' || substring(hex(encode({text})), 2 * i - 1, 2)) AS BIGINT))"
    return f"xor(list_reduce({code}, lambda a, b: xor(a >> 8, t[1 + xor(a, b) % 256]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR)))::VARCHAR || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _level(name: str, before: str, group: str) -> str:
    """The nodes over those of ``before`` (group, i, h, number n of the group's), and for these the siblings and places."""
    return (
        f"{name} AS (SELECT {group}, i // 3 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, CASE WHEN any_value(n) = 1 THEN 1 ELSE (any_value(n) + 2) // 3 END AS n,"
        f" CASE WHEN any_value(n) = 1 THEN '' ELSE string_agg(h, '' ORDER BY i) END AS run FROM {before} GROUP BY {group}, i // 3)"
    )


def merkle(levels: int = 12) -> str:
    """SQL for the manifest, for sources and source counts of up to 3 ** levels."""
    ctes = [f"crc AS ({_crc_table()})"]
    ctes.append(f"d AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, {_leaf('text')} AS leaf, CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS changed FROM documents, crc)")
    ctes.append("l0 AS (SELECT g, CAST(row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS BIGINT) AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n, doc_id, changed FROM d)")
    for k in range(levels):
        ctes.append(_level(f"l{k + 1}", f"l{k}", "g"))
    ctes.append(f"r0 AS (SELECT 0 AS o, g, CAST(row_number() OVER (ORDER BY g) - 1 AS BIGINT) AS i, h, count(*) OVER () AS n FROM l{levels})")
    for k in range(levels):
        ctes.append(_level(f"r{k + 1}", f"r{k}", "o"))
    walk, joins = "SELECT l0.doc_id, l0.g, l0.h AS leaf, l0.i, '' AS proof, l0.changed AS v FROM l0", []
    for kind in "lr":
        for k in range(levels):
            own, up = f"{kind}{k}", f"{kind}{k + 1}"
            place = "(w.i % 3)"
            key = f"{up}.g = w.g AND {up}.i = w.i // 3" if kind == "l" else f"{up}.i = w.i // 3"
            left, right = f"substring({up}.run, 1, 64 * {place})", f"substring({up}.run, 64 * {place} + 65)"
            walk = (
                f"SELECT w.doc_id, w.g, w.leaf, w.i // 3 AS i, w.proof || {left} || {right} AS proof, CASE WHEN {up}.run = '' THEN w.v ELSE sha256({left} || w.v || {right}) END AS v FROM ({walk}) w JOIN {up} ON {key}"
            )
        if kind == "l":
            walk = f"SELECT w.doc_id, w.g, w.leaf, r0.i, w.proof, w.v FROM ({walk}) w JOIN r0 ON r0.g = w.g"
    ctes.append(f"walk AS ({walk})")
    return f"WITH {', '.join(ctes)} SELECT walk.doc_id, leaf, l{levels}.h AS subroot, r{levels}.h AS root, sha256(proof) AS proof_sha256, v AS folded_root, v = r{levels}.h AS verified FROM walk JOIN l{levels} ON l{levels}.g = walk.g, r{levels}"


OP12 = merkle()

OP11 = rf"""
WITH crc AS ({_crc_table()}),
runs AS (SELECT doc_id, translate(w, '{UPPER}', '{LOWER}') AS w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, c, {_crc("doc_id || ':' || w")} AS h FROM runs, crc),
noisy AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM noisy WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
place AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
wild AS (SELECT word, substring(word, 1, i - 1) || '*' || substring(word, i + 1) AS k FROM place),
cut AS (SELECT DISTINCT word, substring(word, 1, i - 1) || substring(word, i + 1) AS k FROM place),
pair AS (SELECT a.word AS x, b.word AS y FROM wild a JOIN wild b ON a.k = b.k AND a.word != b.word UNION SELECT cut.word, v.word FROM cut JOIN v ON v.word = cut.k UNION SELECT v.word, cut.word FROM cut JOIN v ON v.word = cut.k),
best AS (SELECT x, count(*) OVER (PARTITION BY x) AS n_near, y, n AS m, row_number() OVER (PARTITION BY x ORDER BY n DESC, encode(y)) AS r FROM pair JOIN v ON v.word = y),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN y END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON x = v.word AND r = 1),
step AS (SELECT word AS start, word AS here FROM form),
{", ".join(f"step{k} AS (SELECT start, coalesce(form, here) AS here FROM {'step' if k == 0 else f'step{k - 1}'} JOIN form ON form.word = here)" for k in range(12))}
SELECT word, form, here AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM form JOIN step11 ON start = word
"""
