"""SQL for the checks: the same results by another engine's own functions."""

from __future__ import annotations

from ..functions.identity import PREFIX
from ..operators.blocks import BLOCK_TAGS


def field(e: str) -> str:
    return f"unhex(printf('%016x', octet_length(encode({e})))) || encode({e})"


def word(s: str) -> str:
    return f"unhex('{len(s.encode()):016x}') || encode('{s}')"


def raw(e: str) -> str:
    return f"unhex('0000000000000020') || unhex({e})"


def u64(e: str) -> str:
    return f"unhex('0000000000000008') || unhex(printf('%016x', CAST({e} AS BIGINT)))"


def tuple_hash(*fields: str) -> str:
    return f"sha256({' || '.join(fields)})"


def tag(kind: str) -> str:
    return word(f"{PREFIX}.{kind}.v1")


EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

ITEMS = f"""
norm AS (
  SELECT doc_id, coalesce(source, '') AS src, source, regexp_replace(regexp_replace(coalesce(text, ''), '^\\x{{FEFF}}', ''), '\\r\\n?', chr(10), 'g') AS body,
    sha256(encode(coalesce(text, ''))) AS raw_sha256 FROM documents),
item1 AS (SELECT *, sha256(encode(body)) AS content_sha256, {tuple_hash(tag("source"), word("corpus"), field("src"))} AS source_id FROM norm),
item2 AS (SELECT *, {tuple_hash(tag("observation"), raw("source_id"), field("'item/' || CAST(doc_id AS VARCHAR) || '@' || raw_sha256"))} AS observation_id FROM item1),
item3 AS (SELECT *, {tuple_hash(tag("artifact"), raw("observation_id"), word("raw"))} AS artifact_id FROM item2),
items AS (SELECT *, {tuple_hash(tag("representation"), u64("1"), word("artifact"), raw("artifact_id"), word("text-normalizer"), word("1"), raw(f"'{EMPTY}'"), word("text/plain; charset=utf-8"), raw("content_sha256"))} AS representation_id FROM item3)"""


def _back(h: str, at: str) -> str:
    cont = lambda k: f"substr({h}, 2 * ({at} - {k}) + 1, 2) BETWEEN '80' AND 'BF'"
    return f"CASE WHEN NOT {cont(0)} THEN 0 WHEN NOT {cont(1)} THEN 1 WHEN NOT {cont(2)} THEN 2 ELSE 3 END"


SEGMENTS = f"""{ITEMS},
cuts(doc_id, h, n, ordinal, start, stop) AS (
  SELECT doc_id, h, n, 0, 0, CASE WHEN 4096 >= n THEN n ELSE 4096 - {_back("h", "4096")} END
  FROM (SELECT doc_id, hex(encode(body)) AS h, octet_length(encode(body)) AS n FROM items) WHERE n > 0
  UNION ALL
  SELECT doc_id, h, n, ordinal + 1, stop, CASE WHEN stop + 4096 >= n THEN n ELSE stop + 4096 - {_back("h", "(stop + 4096)")} END FROM cuts WHERE stop < n),
seg1 AS (SELECT doc_id, source, source_id, observation_id, representation_id, ordinal, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, unhex(substr(h, 2 * start + 1, 2 * (stop - start))) AS data FROM cuts JOIN items USING (doc_id)),
seg2 AS (SELECT *, decode(data) AS text, sha256(data) AS content_sha256 FROM seg1),
segs AS (SELECT *, {tuple_hash(tag("segment"), raw("representation_id"), word(f"{PREFIX}.selector.text-byte-range.v1"), u64("start"), u64("stop"), raw("content_sha256"))} AS segment_id FROM seg2)"""


def tokens(e: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({e})), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


INDEX = f"""{SEGMENTS},
toks AS (SELECT segment_id, {tokens("text")} AS t FROM segs),
tok AS (SELECT segment_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS position FROM toks),
lens AS (SELECT segment_id, len(t) AS n_tokens FROM toks),
stats AS (SELECT count(*) AS n_rows, sum(n_tokens) / count(*) AS avg_tokens FROM lens)"""

TERMS = """
cut_terms AS (
  SELECT item_id AS query_id, list_filter(list_transform(regexp_split_to_array(text, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
    lambda t: lower(regexp_replace(t, '^[\\p{Z}\\x{85}]+|[\\p{Z}\\x{85}]+$', '', 'g'))), lambda t: t <> '') AS t FROM benchmark),
each_term AS (SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS ordinal FROM cut_terms),
sized AS (SELECT *, sum(octet_length(encode(term)) + 2 + CASE WHEN ordinal > 0 THEN 4 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY ordinal) AS size FROM each_term),
terms AS (SELECT query_id, term, ordinal FROM sized WHERE size <= 4096 OR ordinal = 0)"""

SCORES = f"""{INDEX},{TERMS},
asked AS (SELECT query_id, ordinal, array_to_string({tokens("term")}, ' ') AS phrase FROM terms WHERE len({tokens("term")}) > 0),
parts AS (SELECT phrase, len(p) AS n, unnest(p) AS term, generate_subscripts(p, 1) - 1 AS j FROM (SELECT DISTINCT phrase, string_split(phrase, ' ') AS p FROM asked)),
starts AS (SELECT phrase, segment_id, position - j AS place FROM tok JOIN parts USING (term) GROUP BY phrase, segment_id, position - j, n HAVING count(*) = n),
found AS (SELECT phrase, segment_id, count(*) AS f FROM starts GROUP BY ALL),
dfs AS (SELECT phrase, count(*) AS df FROM found GROUP BY ALL),
rated AS (
  SELECT phrase, segment_id, (CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_rows - df + 0.5) / (df + 0.5)) END)
    * ((f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_tokens / avg_tokens))) AS x
  FROM found JOIN dfs USING (phrase) JOIN lens USING (segment_id) CROSS JOIN stats),
scores AS (SELECT query_id, segment_id, -1 * sum(x ORDER BY ordinal) AS score FROM asked JOIN rated USING (phrase) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), segment_id) AS rank FROM scores),
top AS (SELECT * FROM ranked WHERE rank <= 100),
cands AS (SELECT query_id, segment_id, doc_id, rank, content_sha256, stop - start AS bytes FROM top JOIN segs USING (segment_id))"""


def with_(pieces: str, select: str) -> str:
    return f"WITH RECURSIVE {pieces}\n{select}"


#: The greedy packing, a step of the recursion per rank.
PACKED = f"""{SCORES},
walk(query_id, rank, used, sel, seen) AS (
  SELECT query_id, rank, CASE WHEN bytes <= 8192 THEN bytes ELSE 0 END, bytes <= 8192, CASE WHEN bytes <= 8192 THEN [content_sha256] ELSE [] END FROM cands WHERE rank = 1
  UNION ALL
  SELECT c.query_id, c.rank, used + CASE WHEN used + bytes <= 8192 THEN bytes ELSE 0 END, used + bytes <= 8192, seen FROM walk w JOIN cands c ON c.query_id = w.query_id AND c.rank = w.rank + 1)"""

PACKED_EXACT = f"""{SCORES},
walk(query_id, rank, used, omission, seen) AS (
  SELECT query_id, rank, CASE WHEN bytes <= 8192 THEN bytes ELSE 0 END, CASE WHEN bytes <= 8192 THEN NULL ELSE 'budget' END, CASE WHEN bytes <= 8192 THEN [content_sha256] ELSE [] END FROM cands WHERE rank = 1
  UNION ALL
  SELECT c.query_id, c.rank, used + CASE WHEN list_contains(seen, content_sha256) OR used + bytes > 8192 THEN 0 ELSE bytes END,
    CASE WHEN list_contains(seen, content_sha256) THEN 'duplicate' WHEN used + bytes > 8192 THEN 'budget' END,
    CASE WHEN list_contains(seen, content_sha256) OR used + bytes > 8192 THEN seen ELSE list_append(seen, content_sha256) END
  FROM walk w JOIN cands c ON c.query_id = w.query_id AND c.rank = w.rank + 1)"""


_WHITE = r"[ \t\n\r\x0B\f\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _plain(e: str) -> str:
    # The character references that the tables hold; the ampersand's own comes last.
    for name, sign in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        e = f"replace({e}, '&{name};', '{sign}')"
    return f"trim(regexp_replace({e}, '{_WHITE}', ' ', 'g'))"


def _blocks(key: str) -> str:
    """From parts (block, o, start, stop, part, heading) to blocks with the nearest heading."""
    return f"""
found AS (SELECT {key}, block, min(start) AS start, max(stop) AS stop, {{text}} AS text, bool_or(heading) AS is_heading FROM parts GROUP BY {key}, block),
blocks AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY start) - 1 AS INT) AS ordinal, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, text, is_heading FROM found WHERE text <> ''),
headed AS (SELECT *, last_value(CASE WHEN is_heading THEN ordinal END IGNORE NULLS) OVER w AS heading_ordinal, last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER w AS heading
  FROM blocks WINDOW w AS (PARTITION BY {key} ORDER BY ordinal ROWS UNBOUNDED PRECEDING))"""


MD_BLOCKS = (
    r"""
line1 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS o FROM documents),
line2 AS (SELECT *, regexp_replace(regexp_replace(l, '^[ \t\n\r\x0B\f]+', ''), '[ \t\n\r\x0B\f]+$', '') AS bare, strlen(l) AS n FROM line1),
line3 AS (SELECT *, coalesce(sum(n + 1) OVER w, 0) AS start, coalesce(count(*) FILTER (starts_with(bare, '```')) OVER w, 0) % 2 = 1 AS in_code
  FROM line2 WINDOW w AS (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
line4 AS (SELECT *, start + n AS stop, CASE WHEN starts_with(bare, '```') OR bare = '' THEN 'none' WHEN NOT in_code AND regexp_matches(bare, '^#{1,6}[ \t\n\r\x0B\f]') THEN 'heading'
  WHEN in_code OR regexp_matches(l, '^(?:[ \t\n\r\x0B\f]*(?:[-*+]|[0-9]+\.)[ \t\n\r\x0B\f]|\|)') THEN 'single' ELSE 'prose' END AS kind FROM line3),
line5 AS (SELECT *, CASE WHEN kind = 'prose' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY o) = 'prose' THEN 0 ELSE 1 END AS opens FROM line4),
line6 AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS block FROM line5),
parts AS (SELECT doc_id, block, o, start, stop, kind = 'heading' AS heading, CASE WHEN kind = 'heading' THEN regexp_replace(bare, '^#{1,6}[ \t\n\r\x0B\f]+', '') ELSE l END AS part FROM line6 WHERE kind <> 'none'),"""
    + _blocks("doc_id").replace("{text}", _plain("string_agg(part, chr(10) ORDER BY o)"))
)

HTML_BLOCKS = (
    r"""
tok1 AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?s)<!--.*?-->|</?[a-zA-Z0-9]+[^>]*>|[^<]+|<') AS t FROM pages),
tok2 AS (SELECT page_id, unnest(t) AS t, generate_subscripts(t, 1) AS o FROM tok1),
tok3 AS (SELECT *, coalesce(sum(strlen(t)) OVER (PARTITION BY page_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, t[1] = '<' AND len(t) > 1 AS markup,
  CASE WHEN t[1] = '<' AND len(t) > 1 THEN lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) END AS name, t[1:2] = '</' AS closes FROM tok2),
tok4 AS (SELECT *, coalesce(last_value(CASE WHEN name IN ('script', 'style') THEN NOT closes END IGNORE NULLS) OVER w, false) AS silent,
  coalesce(last_value(CASE WHEN regexp_full_match(name, 'title|h[1-6]') THEN CASE WHEN closes THEN '' ELSE name END END IGNORE NULLS) OVER w, '') AS inside,
  count(*) FILTER (name IN ({tags})) OVER w AS block, count(*) FILTER (markup) OVER w AS run
  FROM tok3 WINDOW w AS (PARTITION BY page_id ORDER BY o ROWS UNBOUNDED PRECEDING)),
runs AS (SELECT page_id, block, run AS o, min(start) AS start, inside <> '' AS heading, string_agg(t, '' ORDER BY o) AS whole FROM tok4 WHERE NOT markup AND NOT silent AND inside <> 'title' GROUP BY page_id, block, run, inside),
run2 AS (SELECT *, regexp_replace(whole, '^[ \t\n\r\x0B\f]+', '') AS cut FROM runs),
parts AS (SELECT page_id, block, o, heading, start + strlen(whole) - strlen(cut) AS start, regexp_replace(cut, '[ \t\n\r\x0B\f]+$', '') AS part, start + strlen(whole) - strlen(cut) + strlen(regexp_replace(cut, '[ \t\n\r\x0B\f]+$', '')) AS stop FROM run2 WHERE cut <> ''),""".replace(
        "{tags}", ", ".join(f"'{t}'" for t in BLOCK_TAGS)
    )
    + _blocks("page_id").replace("{text}", _plain("string_agg(part, ' ' ORDER BY o)"))
)

CHUNKS = f"""{MD_BLOCKS},
sized AS (SELECT *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS n FROM blocks),
fold(doc_id, ordinal, chunk, used) AS (
  SELECT doc_id, ordinal, CAST(0 AS BIGINT), n FROM sized WHERE ordinal = 0
  UNION ALL
  SELECT b.doc_id, b.ordinal, CASE WHEN used + n > 450 THEN chunk + 1 ELSE chunk END, CASE WHEN used + n > 450 THEN n ELSE used + n END FROM fold JOIN sized b ON b.doc_id = fold.doc_id AND b.ordinal = fold.ordinal + 1)"""
