"""Queries of line, chunk and segment sources over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENSITIVE, lines, safe_path
from ..sources import spans, text_source as S
from .registry import Tables, query

_LINES = "CASE WHEN text = '' THEN [] WHEN suffix(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"


@query("content_hash", f"SELECT doc_id, sha256(text) AS content_hash, CAST(len({_LINES}) AS INTEGER) AS n_lines, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.size(lines("text")).alias("n_lines"), F.octet_length("text").alias("n_bytes"))


@query("grep_lines", f"""SELECT doc_id, CAST(line AS INTEGER) AS line, content FROM (SELECT doc_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS line FROM (SELECT doc_id, {_LINES} AS l FROM documents))
    WHERE contains(content, 'License') ORDER BY doc_id, line LIMIT 50""")
def grep_lines(t: Tables) -> DataFrame:
    return S.grep(t.documents.select("doc_id", "text"), "doc_id", "License", 50)


@query("range_read", f"SELECT doc_id, array_to_string(l[2:4], chr(10)) AS lines, CAST(len(l) AS INTEGER) AS n_lines FROM (SELECT doc_id, {_LINES} AS l FROM documents)")
def range_read(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.line_range("text", 2, 4).alias("lines"), F.size(lines("text")).alias("n_lines"))


_CHUNKS = f"""WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents), p AS (SELECT doc_id, l, unnest(range(1, len(l) + 1, 20)) AS start_line FROM l),
    c AS (SELECT doc_id, CAST((start_line - 1) / 20 AS INTEGER) AS part, CAST(start_line AS INTEGER) AS start_line, CAST(least(start_line + 19, len(l)) AS INTEGER) AS end_line, sha256(array_to_string(l[start_line:start_line + 19], chr(10))) AS content_hash FROM p)"""


@query("chunk_line_partition", f"{_CHUNKS} SELECT * FROM c")
def chunk_line_partition(t: Tables) -> DataFrame:
    return S.line_chunks(t.documents.select("doc_id", "text"), "doc_id", 20)


_OPEN = "'html', 'head', 'body', 'nav', 'ul', 'li', 'article', 'div', 'footer', 'section', 'table'"
_SPANS = f"""WITH RECURSIVE
    s AS (SELECT page_id, list_filter(string_split(regexp_replace(html, '(<[^>]*>)', chr(10) || '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS l FROM pages),
    n AS (SELECT page_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS line, regexp_extract(content, '^</?([a-z0-9]+)', 1) AS name FROM s),
    t AS (SELECT *, CASE WHEN name NOT IN ({_OPEN}, 'a', 'title', 'style', 'script', 'h1', 'h2', 'h3') THEN 0 WHEN content LIKE '</%' THEN -1 ELSE 1 END AS step, name IN ({_OPEN}) AS owns FROM n),
    w AS (SELECT page_id, 0::BIGINT AS line, 0 AS step, [{{'line': 0::BIGINT, 'owns': true, 'name': NULL::VARCHAR}}] AS stack, [{{'line': 0::BIGINT, 'owns': true, 'name': NULL::VARCHAR}}] AS before FROM s
          UNION ALL SELECT w.page_id, t.line, CASE WHEN t.step = -1 AND len(w.stack) = 1 THEN 0 ELSE t.step END,
                 CASE WHEN t.step = 1 THEN list_append(w.stack, {{'line': t.line, 'owns': t.owns, 'name': t.name}}) WHEN t.step = -1 AND len(w.stack) > 1 THEN w.stack[:-2] ELSE w.stack END,
                 CASE WHEN t.step = 1 THEN list_append(w.stack, {{'line': t.line, 'owns': t.owns, 'name': t.name}}) ELSE w.stack END
          FROM w JOIN t ON t.page_id = w.page_id AND t.line = w.line + 1),
    o AS (SELECT page_id, line, list_filter(before, lambda x: x.owns)[-1] AS own, (step = 0 AND before[-1].owns) OR (step = -1 AND NOT before[-1].owns AND before[-2].owns) AS ends FROM w WHERE line > 0),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY line) AS stretch FROM (SELECT *, CASE WHEN own.line = lag(own.line) OVER (PARTITION BY page_id ORDER BY line) THEN 0 ELSE 1 END AS fresh FROM o)),
    g AS (SELECT page_id, stretch, any_value(own.line) AS owner, any_value(own.name) AS owner_name, min(line) AS first, max(line) AS last, list_sort(list_distinct(list_append(coalesce(list(line) FILTER (ends), []), max(line)))) AS may FROM r GROUP BY page_id, stretch),
    c AS (SELECT *, first AS start_line, coalesce(list_max(list_filter(may, lambda x: x < first + {{most}})), list_min(may)) AS end_line FROM g
          UNION ALL SELECT page_id, stretch, owner, owner_name, first, last, may, end_line + 1, coalesce(list_max(list_filter(may, lambda x: x > c.end_line AND x < c.end_line + 1 + {{most}})), list_min(list_filter(may, lambda x: x > c.end_line))) FROM c WHERE end_line < last)
    SELECT page_id, CAST(owner AS INTEGER) AS owner, owner_name, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(row_number() OVER (PARTITION BY page_id, owner ORDER BY start_line) AS INTEGER) AS part,
           CAST(count(*) OVER (PARTITION BY page_id, owner) AS INTEGER) AS parts, end_line - start_line + 1 > {{most}} AS oversized FROM c"""


@query("owned_spans", _SPANS.replace("{most}", "4"))
def owned_spans(t: Tables) -> DataFrame:
    """SRC-14 on pages: every tag and text is a line, elements own their lines; parts of four lines, so that there is much to cut."""
    return spans.owned_spans(spans.page_lines(t.pages.select("page_id", "html"), "page_id"), "page_id", 4)


@query("chunk_cover_check", f"{_CHUNKS}, g AS (SELECT * FROM c WHERE part % 3 <> 1), w AS (SELECT doc_id, part, start_line, CAST(coalesce(lag(end_line) OVER (PARTITION BY doc_id ORDER BY start_line, part), 0) + 1 AS INTEGER) AS expected FROM g) SELECT * FROM w WHERE start_line <> expected")
def chunk_cover_check(t: Tables) -> DataFrame:
    """Every third part is taken out, so that there are gaps to find."""
    chunks = S.line_chunks(t.documents.select("doc_id", "text"), "doc_id", 20).where("part % 3 <> 1")
    return S.cover_breaks(chunks, "doc_id")


_ROOM = 1800 - len(S.PREFIX)
_NEXT = f"CASE WHEN length(text) - {{at}} <= {_ROOM} THEN length(text) WHEN instr(reverse(text[{{at}} + 1 : {{at}} + {_ROOM}]), chr(10)) > 0 THEN {{at}} + {_ROOM} - instr(reverse(text[{{at}} + 1 : {{at}} + {_ROOM}]), chr(10)) + 1 ELSE {{at}} + {_ROOM} END"


@query("segment_windows", f"""WITH RECURSIVE s AS (SELECT doc_id, text, 0 AS segment, 0::BIGINT AS a, {_NEXT.format(at="0")} AS b FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    UNION ALL SELECT doc_id, text, segment + 1, b, {_NEXT.format(at="b")} FROM s WHERE b < length(text))
    SELECT doc_id, segment, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS segments, CAST(a AS INTEGER) AS start_offset, CAST(b AS INTEGER) AS end_offset, sha256(concat('Python code:', chr(10), text[a + 1 : b])) AS text_hash FROM s""")
def segment_windows(t: Tables) -> DataFrame:
    """SRC-16 and WIN-06."""
    return S.segments(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "segment", "segments", "start_offset", "end_offset", F.sha2("text", 256).alias("text_hash"))


@query("snapshot_diff", """WITH b AS (SELECT doc_id, md5(text) AS d FROM documents WHERE doc_id % 11 <> 0), a AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS d FROM documents WHERE doc_id % 13 <> 0)
    SELECT doc_id, CASE WHEN b.d IS NULL THEN 'added' WHEN a.d IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (doc_id) WHERE b.d IS DISTINCT FROM a.d""")
def snapshot_diff(t: Tables) -> DataFrame:
    """Two snapshots made of one table: some documents only in either, some with another text."""
    before = t.documents.where("doc_id % 11 <> 0").select("doc_id", F.md5("text").alias("digest"))
    after = t.documents.where("doc_id % 13 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("digest"))
    return S.snapshot_diff(before, after, "doc_id", "digest")


def sensitive_sql(text: str) -> str:
    """FLT-05 for engines without look-around: what stands for a redacted value is made a pair of quotes, which no value begins with, and a number's neighbours are part of the match."""
    pattern = SENSITIVE.replace(r"(?!\[redacted\]|<redacted>)", "").replace(r"(?<!\d)", r"(?:^|[^\d])").replace(r"(?!\d)", r"(?:[^\d]|$)").replace("'", "''")
    return f"""regexp_matches(regexp_replace({text}, '(?i)\\[redacted\\]|<redacted>', '""', 'g'), '{pattern}')"""


@query("sensitive_content", f"SELECT doc_id FROM documents WHERE {sensitive_sql('text')}")
def sensitive_content(t: Tables) -> DataFrame:
    """FLT-05."""
    return t.documents.where(F.col("text").rlike(SENSITIVE)).select("doc_id")


_CASES = ["password = [redacted]", "密码：abc", "手机号: 1", "call +86 13912345678 now", "id 2139123456789", "postgresql+asyncpg://u:p@h", "token：x", 'api_key="<redacted>"', "cookie: ", "13912345678"]


@query("sensitive_cases", f"SELECT source, x.case_text, {sensitive_sql('x.case_text')} AS sensitive FROM (SELECT DISTINCT source FROM documents), (VALUES {', '.join(f"('{c}')" for c in _CASES)}) AS x(case_text)")
def sensitive_cases(t: Tables) -> DataFrame:
    """FLT-05 on cues that the documents lack: each case once for every source."""
    cases = F.explode(F.array(*(F.lit(c) for c in _CASES)))
    return t.documents.select("source").distinct().select("source", cases.alias("case_text")).withColumn("sensitive", F.col("case_text").rlike(SENSITIVE))


@query("safe_paths", r"""SELECT page_id, NOT starts_with(p, '/') AND NOT contains(p, ':') AND NOT contains(p, '\') AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe
    FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)""")
def safe_paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", safe_path(F.regexp_replace("url", "^https?://", "")).alias("safe"))


@query("redact_text", "SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<redacted>', 'g')) AS redacted_md5 FROM documents")
def redact_text(t: Tables) -> DataFrame:
    """PRJ-12: addresses masked."""
    return t.documents.select("doc_id", F.md5(F.regexp_replace("text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<redacted>")).alias("redacted_md5"))
