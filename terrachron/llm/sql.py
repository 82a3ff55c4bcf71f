"""DuckDB SQL for the operators of this subpackage that SQL can express.

The other operators need a CRC-32, the jump hash's key, tokens or a trained model, which
SQL lacks; tests/llm compares those with plain-Python versions.
"""

from __future__ import annotations

from terrachron.llm import chat

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


def _joined(n: int) -> str:
    """A word and the n - 1 that follow; null where the text ends earlier."""
    return " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER w" for i in range(1, n))])


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secrets() -> str:
    keys = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
    # written for this query: kind, pattern without look-around, group, least characters; a key without a footer is left to the tests
    kinds = [
        ("assign", rf"""(?:{keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
        ("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*", 0, 15),
        ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s*[A-Z][A-Za-z]*-[A-Za-z-]+: ?[^\r\n\\]*)*([A-Za-z0-9+/=\s\\]+)-----END [A-Z ]*PRIVATE KEY-----", 1, 20),
        ("opaque", "[A-Za-z0-9_-]{20,}", 0, 20),
    ]
    values = lambda k, p, g: f"list_transform(regexp_extract_all(text, {_quoted(p)}, {g}), lambda v: regexp_replace(v, '\\\\[rn]|[\\s\\\\]', '', 'g'))" if k == "private_key" else f"regexp_extract_all(text, {_quoted(p)}, {g})"
    each = " UNION ALL ".join(
        f"SELECT uid, repo, owner, '{k}' AS kind, {rank} AS rank, {n} AS least, regexp_split_to_array(text, {_quoted(p)}) AS between_, regexp_extract_all(text, {_quoted(p)}, 0) AS found, {values(k, p, g)} AS vals FROM d"
        for rank, (k, p, g, n) in enumerate(kinds)
    )
    base, names = 3, [k for k, *_ in kinds]
    return f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat(coalesce(source, ''), '/', coalesce(lang, '')) AS repo FROM documents),
 k AS ({each}),
 m AS (SELECT uid, repo, owner, kind, rank, least, unnest(list_slice(between_, 1, len(found))) AS b, unnest(found) AS f, unnest(vals) AS v, generate_subscripts(found, 1) AS nth FROM k WHERE len(found) > 0),
 p AS (SELECT *, CAST(sum(length(b) + length(f)) OVER (PARTITION BY uid, kind ORDER BY nth) AS BIGINT) AS stop FROM m),
 s AS (SELECT *, stop - length(f) AS start FROM p WHERE length(v) >= least AND (kind <> 'opaque' OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))),
 o AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM s GROUP BY v),
 l AS (SELECT s.*, len(list_distinct(string_split(s.v, ''))) >= 8 AND regexp_matches(s.v, '[0-9]') AND owners <= 1 AND repos <= 4 AS live FROM s JOIN o ON s.v = o.v),
 t AS (SELECT uid, rank, live, kind, start, concat(kind, ':', start, ':', stop) AS shown FROM l WHERE rank < {base} OR live),
 g AS (SELECT uid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in names[:base])}, string_agg(shown, ',' ORDER BY start, rank) FILTER (rank < {base}) AS base,
  string_agg(shown, ',' ORDER BY start, rank) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM t GROUP BY uid)
 SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in names[:base])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
 FROM d LEFT JOIN g ON d.uid = g.uid"""


def _decontam(window: int = 10) -> str:
    words = _words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    sizes = " UNION ALL ".join(f"SELECT uid, item, n, pos, {i} AS size, {_joined(i)} AS win FROM x WINDOW w AS (PARTITION BY uid ORDER BY pos)" for i in range(1, window + 1))
    return f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {words} AS w FROM documents),
 b AS (SELECT -row_number() OVER () AS uid, coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
 sizes AS (SELECT DISTINCT least({window}, len(w)) AS size FROM b WHERE len(w) > 0),
 x AS (SELECT uid, item, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT uid, item, w FROM b UNION ALL SELECT uid, NULL, w FROM d)),
 wins AS (SELECT uid, item, n, pos, y.size, win FROM ({sizes}) y JOIN sizes ON y.size = sizes.size WHERE win IS NOT NULL),
 known AS (SELECT DISTINCT size, win, item FROM wins WHERE uid < 0 AND size = least({window}, n)),
 hit AS (SELECT wins.uid, pos, wins.size, known.item FROM wins JOIN known ON wins.win = known.win AND wins.size = known.size WHERE wins.uid > 0),
 h AS (SELECT uid, count(DISTINCT k) AS n_hit FROM (SELECT uid, unnest(range(pos, pos + size)) AS k FROM (SELECT DISTINCT uid, pos, size FROM hit)) GROUP BY uid),
 i AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item FROM hit) GROUP BY uid)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN h ON d.uid = h.uid LEFT JOIN i ON d.uid = i.uid"""


def _warc(least: int = 100) -> str:
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT payload_digest AS digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {least} GROUP BY payload_digest),
 r AS (SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM p LEFT JOIN f ON payload_digest = digest)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""


def _chat() -> str:
    def escaped(column: str, line: bool = False) -> str:
        out = f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"
        return f"replace({out}, chr(10), '&NewLine;')" if line else out

    said, order = "</s>[INST] ok [/INST]", "turn NULLS FIRST, role, text"
    run = len(chat.HEAD) + 1 + len(chat.END)
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{said}' UNION ALL SELECT -1, 1, 'assistant', '{said}'),
 l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY {order}) IS DISTINCT FROM role AS fresh FROM t),
 c AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY {order}) AS told, coalesce(string_agg(text, '' ORDER BY {order}) FILTER (role = '{chat.LEARNT}'), '') AS loss,
  CAST(sum(length({escaped('text')}) + CASE WHEN fresh THEN {run} + length({escaped('role', True)}) ELSE {len(chat.NEXT)} END) AS BIGINT) AS formatted_chars FROM l GROUP BY conv_id)
 SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""


def _neardup(size: int = 5) -> str:
    return rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS uid, doc_id, {_words(r"[^\x20\x09-\x0D]+")} AS w FROM documents),
 x AS (SELECT uid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
 s AS (SELECT DISTINCT uid, sh FROM (SELECT uid, {_joined(size)} AS sh FROM x WINDOW w AS (PARTITION BY uid ORDER BY pos) UNION ALL SELECT uid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {size - 1}) WHERE sh IS NOT NULL),
 n AS (SELECT uid, count(*) AS n FROM s GROUP BY uid),
 i AS (SELECT a.uid AS a, b.uid AS b, count(*) AS i FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.uid < b.uid GROUP BY a.uid, b.uid),
 links AS (SELECT i.a, i.b FROM i JOIN n AS x ON i.a = x.uid JOIN n AS y ON i.b = y.uid WHERE 100 * i.i >= 75 * (x.n + y.n - i.i)),
 known AS (SELECT a, b FROM links JOIN d AS p ON a = p.uid JOIN d AS q ON b = q.uid WHERE p.doc_id IS NOT NULL AND q.doc_id IS NOT NULL),
 both_ AS (SELECT a, b FROM known UNION ALL SELECT b, a FROM known),
 reach AS (SELECT uid AS a, uid AS b FROM d UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
 low AS (SELECT reach.a AS uid, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.b = d.uid GROUP BY reach.a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(component_id = d.doc_id, true) AS kept FROM d LEFT JOIN n ON d.uid = n.uid JOIN low ON d.uid = low.uid"""


def _collocations(longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> str:
    sizes = ", ".join(f"({k})" for k in range(1, longest + 1))
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
 g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
 f AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS n FROM g, (VALUES {sizes}) AS v(size) WHERE i + size - 1 <= len(ws) GROUP BY 1, 2, 3),
 t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY 1),
 c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND n >= {least}),
 u AS (SELECT *, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS cut FROM c)),
 k AS (SELECT u.*, x.n AS l, y.n AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score FROM u JOIN f AS x ON x.lang = u.lang AND x.phrase = u.head JOIN f AS y ON y.lang = u.lang AND y.phrase = u.rest),
 m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM m
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = m.lang AND c.size > m.size AND 100 * c.a >= {share} * m.a AND contains(concat(' ', c.phrase, ' '), concat(' ', m.phrase, ' '))))
 SELECT q.lang, rank, phrase, a, l, r, t.n, score FROM q JOIN t ON t.lang = q.lang WHERE rank <= {top}"""


SQL = {"op1_secrets": _secrets(), "op2_decontam": _decontam(), "op5_warc": _warc(), "op6_chat": _chat(), "op8_neardup": _neardup(), "op13_collocations": _collocations()}
