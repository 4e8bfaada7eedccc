"""DuckDB twins of the registered extraction queries.

Pages are parsed by regular expressions here and by a tokenising parser in the engine,
so agreement is evidence about both. Elsewhere the expected value is spelled out.
"""

from __future__ import annotations

# White space as the engine strips it, dividers, titles, names of files and log lines.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return rf"regexp_replace({x}, '[ \t]*[\r\n]+[ \t]*', '', 'g')"


def _clean(x: str) -> str:
    return _strip(_collapse(x))


def _divider(x: str) -> str:
    return rf"regexp_matches({x}, '^[＊*・○●◎□■▽△◇☆★†‡~〜\-－ー]{{1,10}}$')"


def _join(x: str) -> str:
    return rf"regexp_replace(regexp_replace(array_to_string({x}, chr(10)), '^\n+|\n+$', '', 'g'), '\n{{2,}}', chr(10) || chr(10), 'g')"


def _chapter(x: str) -> str:
    s = _strip(x)
    return f"(regexp_matches({s}, '^[0-9０-９]+$') OR regexp_matches({s}, '^第[0-9０-９一二三四五六七八九十百千]+[章話部編]$') OR regexp_matches({s}, '^[Cc]hapter{WS}*[0-9０-９]+$'))"


def _file(x: str) -> str:
    plain = f"regexp_replace({_strip(f"regexp_replace({x}, '[\\\\/:*?\"<>|]', '_', 'g')")}, '{WS}+', ' ', 'g')"
    return f"substring(coalesce(nullif({plain}, ''), 'untitled'), 1, 60)"


def _stem(x: str) -> str:
    return rf"regexp_replace(regexp_extract({x}, '([^/]*)/*$', 1), '^(.+)\.[^.]+$', '\1')"


def _entities(x: str) -> str:
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&#39;", "''")):
        x = f"replace({x}, '{name}', '{value}')"
    return rf"replace(regexp_replace({x}, '&amp([^;]|$)', '&amp;\1', 'g'), '&amp;', '&')"


def _blocks(html: str) -> str:
    """A list of paragraphs of the driver's kind of pages."""
    x = f"regexp_replace({html}, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<head.*?</head>', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)<(p|h[1-6]|li)(\s[^>]*)?>', chr(1) || chr(2), 'g')"
    x = rf"regexp_replace({x}, '(?i)</?(p|h[1-6]|li|ul|ol|nav|div|article|footer|body|html)(\s[^>]*)?>', chr(1), 'g')"
    x = _entities(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
    marked = f"list_filter(string_split({x}, chr(1)), lambda b: b[1] = chr(2))"
    text = _clean("replace(b, chr(2), '')")
    return f"list_transform({marked}, lambda b: CASE WHEN {_divider(text)} THEN '' ELSE {text} END)"


def _element(name: str) -> str:
    inner = rf"regexp_extract(html, '(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>', 1)"
    return f"nullif({_clean(_entities(f"regexp_replace({inner}, '<[^>]*>', '', 'g')"))}, '')"


def _pick(values: list[str], at: str) -> str:
    return f"([{', '.join(values)}])[CAST({at} AS INTEGER) + 1]"


def _quoted(values: tuple[str, ...]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


_NAMES = ("第一章", "12", "Chapter 3", "プロローグ", "note/1", "１")
_WORDS = "regexp_replace(text, '[^a-zA-Z]+', 'x', 'g')"
#: Items found, with what their content gives; z is the book's number of spine rows.
_BOOK = f"""
WITH s AS (SELECT conv_id AS book_id, turn + 1 AS pos, turn, text, (conv_id + turn) AS k FROM conversations),
z AS (SELECT book_id, count(*) AS total FROM s GROUP BY book_id),
b AS (
  SELECT s.book_id, pos, total, turn,
    CASE WHEN k % 7 = 0 THEN 'part' || turn ELSE {_pick(_quoted(_NAMES), "k % 6")} END AS title,
    CASE WHEN k % 7 = 0 THEN '' ELSE {_pick(_quoted(_NAMES), "k % 6")} || chr(10) || {_WORDS} END AS text
  FROM s JOIN z ON s.book_id = z.book_id WHERE turn % 5 <> 4
),
r AS (SELECT *, CASE WHEN text <> '' THEN {_chapter("title")} END AS is_chapter FROM b)
"""
_OWN = f"printf('%03d', pos) || '_' || {_file('title')} || '.txt'"


def _summary(chapters: str, others: str, directory: str, combined: str, blank: str = "text") -> str:
    return f"""{_BOOK}, m AS (SELECT book_id, {blank} AS text, is_chapter FROM r),
    g AS (SELECT book_id, {chapters} AS c, {others} AS n FROM m WHERE text <> '' GROUP BY book_id)
    SELECT z.book_id, total AS total_items, CAST(coalesce(c, 0) AS BIGINT) AS chapter_count, CAST(coalesce(n, 0) AS BIGINT) AS non_chapter_count,
      {directory} AS non_chapter_dir, {combined} AS combined_file, false AS cancelled
    FROM z LEFT JOIN g ON z.book_id = g.book_id"""


_SPLIT = ("count(*) FILTER (WHERE is_chapter)", "count(*) FILTER (WHERE NOT is_chapter)", "CASE WHEN n > 0 THEN 'non-chapters-files' END", "CAST(NULL AS VARCHAR)")
_ALL = ("count(*)", "0")
_HALF = "CASE WHEN book_id % 2 = 0 THEN '' ELSE text END"
_BLANKS = ["chr(12288)", "chr(160)", "chr(133)", "chr(8195) || chr(9)", "chr(28) || ' ' || chr(10)"]
_MARKS = ("＊", "※", "ーー", "＊ ＊", "***********", "-~-", "")
_TITLES = ("１", "16", "第一章", "第3話", "Chapter 5", "chapter　12", " 7 ", "CHAPTER 5", "第〇章", "第一章 始まり", "プロローグ", "")


def _scenes(mark: str) -> str:
    return f"SELECT doc_id, {_join(f"['a', {mark}, 'b']")} AS text FROM (SELECT doc_id, {_pick(_quoted(_MARKS), 'doc_id % 7')} AS m FROM documents)"


_HINT = (
    "'No item has a title that the chapter rules know: all ' || non_chapter_count || ' item(s) are in \"non-chapters-files\". If chapters are among them, "
    "add their titles to Config.chapter_titles, or turn chapter detection off.'"
)
#: Items of the archives made of conversations, with their place in the manifest and whether they are there.
_ARCHIVE = f"""
WITH t AS (SELECT conv_id AS book_id, turn, text, conv_id + turn AS k FROM conversations),
i AS (
  SELECT book_id, turn, 'i' || turn AS item_id, 1 AS o, 'text/part' || turn || '.xhtml' AS name,
    CASE WHEN k % 7 = 0 THEN '<html><body></body></html>' ELSE '<html><body><h1>' || {_pick(_quoted(_NAMES), "k % 6")} || '</h1><p>' || {_WORDS} || '</p></body></html>' END AS content FROM t
  UNION ALL SELECT book_id, turn, 'i' || turn, 0, 'old.xhtml', '<p>old</p>' FROM t WHERE turn % 3 = 0
),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY o, turn) AS ord, (turn + o) % 11 <> 3 AS there FROM i)
"""
#: The chapters that come of them: an older item counts where the newer one is not there.
_READ = f"""{_ARCHIVE},
l AS (SELECT book_id, turn, arg_max(o, ord) AS o FROM n WHERE there AND turn % 5 <> 4 GROUP BY book_id, turn),
b AS (
  SELECT l.book_id, l.turn + 1 AS pos, CASE WHEN o = 0 THEN 'old' WHEN k % 7 = 0 THEN 'part' || l.turn ELSE {_pick(_quoted(_NAMES), 'k % 6')} END AS title,
    CASE WHEN o = 0 THEN 'old' WHEN k % 7 = 0 THEN '' ELSE {_pick(_quoted(_NAMES), 'k % 6')} || chr(10) || {_WORDS} END AS text
  FROM l JOIN t ON l.book_id = t.book_id AND l.turn = t.turn
),
r AS (SELECT *, {_chapter("title")} AS is_chapter, 'book ' || book_id || '/' AS folder FROM b WHERE text <> '')
"""


def oracle_sql() -> dict[str, str]:
    spans = r"regexp_replace(html, '(?i)<(/?)(p|h[1-6]|li)([\s>])', '<\1span\3', 'g')"
    bare = f"regexp_replace({spans}, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<!doctype[^>]*>|<[^>]*>', '', 'g')"
    return {
        "page_blocks": f"SELECT page_id, i - 1 AS para_pos, ps[i] AS text FROM (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT page_id, {_blocks('html')} AS ps FROM pages))",
        "page_text": f"SELECT page_id, {_join('ps')} AS text FROM (SELECT page_id, {_blocks('html')} AS ps FROM pages)",
        "page_title": f"SELECT page_id, title, {_chapter('title')} AS is_chapter FROM (SELECT page_id, coalesce({', '.join(_element(t) for t in ('h1', 'h2', 'h3', 'title'))}, {_stem('url')}) AS title FROM pages)",
        "page_no_block_fallback": f"SELECT page_id, CAST(1 AS BIGINT) AS n, {_clean(_entities(bare))} AS text FROM pages",
        "page_nested_blocks": f"SELECT doc_id, 'a' || {_WORDS} || 'b|cd|e' AS blocks FROM documents",
        "ruby_strip": f"SELECT conv_id, turn, 't漢' || chr(10) || {_WORDS} || '字と空' AS text, 't漢' AS title FROM conversations",
        "ruby_keep": f"SELECT conv_id, turn, 't漢(かん)' || chr(10) || {_WORDS} || '字(よじ)と空' AS text, 't漢' AS title FROM conversations",
        "script_style_dropped": f"SELECT conv_id, turn, {_WORDS} AS text FROM conversations",
        "collapse_newlines": f"SELECT doc_id, {_collapse('text')} AS text FROM documents",
        "unicode_strip": f"SELECT doc_id, {_strip('w || text || w')} AS text FROM (SELECT doc_id, text, {_pick(_BLANKS, 'doc_id % 5')} AS w FROM documents)",
        "scene_breaks": _scenes(f"CASE WHEN {_divider('m')} THEN '' ELSE m END"),
        "scene_breaks_kept": _scenes("m"),
        "paragraph_join": rf"SELECT doc_id, {_join("list_concat([''], list_concat(string_split(regexp_replace(text, '[.] ', chr(10) || chr(10) || chr(10), 'g'), chr(10)), ['', '']))")} AS text FROM documents",
        "chapter_predicate": f"SELECT doc_id, t AS title, {_chapter('t')} AS is_chapter FROM (SELECT doc_id, {_pick(_quoted(_TITLES), 'doc_id % 12')} AS t FROM documents)",
        "safe_filename": f"""SELECT page_id, {_file("CASE WHEN page_id % 9 = 0 THEN ' ' || chr(12288) || ' ' ELSE ' ' || url || ' *?\"<>|' || chr(92) || ' ' || chr(12288) || ' ' || html END")} AS name FROM pages""",
        "fallback_title": f"SELECT page_id, {_stem('n')} AS title FROM (SELECT page_id, url || {_pick(_quoted(('.xhtml', '/a.b.c', '/.a', '/x/', '')), 'page_id % 5')} AS n FROM pages)",
        "padded_index": "SELECT doc_id, printf('%03d', doc_id * 3) AS padded FROM documents",
        "text_length": "SELECT doc_id, length(text) AS n FROM documents",
        "spine_join": f"{_BOOK} SELECT book_id, pos, 'i' || turn AS item_id, 'text/part' || turn || '.xhtml' AS name FROM r",
        "spine_totals": "SELECT conv_id AS book_id, count(*) AS total_items FROM conversations GROUP BY conv_id",
        "empty_filter": f"{_BOOK} SELECT book_id, pos, title, text FROM r WHERE text <> ''",
        "labels": f"{_BOOK} SELECT book_id, pos, CASE WHEN is_chapter THEN 'chapter' ELSE 'non-chapter' END AS label FROM r WHERE text <> ''",
        "labels_flat": f"{_BOOK} SELECT book_id, pos, 'item' AS label, CAST(NULL AS BOOLEAN) AS is_chapter FROM r WHERE text <> ''",
        "chapter_numbering": f"{_BOOK} SELECT book_id, pos, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS chapter_no FROM r WHERE text <> '' AND is_chapter",
        "output_paths": f"""{_BOOK}, q AS (SELECT *, row_number() OVER (PARTITION BY book_id, is_chapter ORDER BY pos) AS n FROM r WHERE text <> '')
            SELECT book_id, CASE WHEN is_chapter THEN 'chapter_' || printf('%03d', n) || '.txt' ELSE 'non-chapters-files/' || {_OWN} END AS rel_path, text FROM q""",
        "flat_paths": f"{_BOOK} SELECT book_id, {_OWN} AS rel_path, text FROM r WHERE text <> ''",
        "single_file": f"""{_BOOK} SELECT book_id, book_id || '_full_text.txt' AS rel_path,
            string_agg(chr(10) || chr(10) || '===== ' || printf('%03d', pos) || ' ' || title || ' =====' || chr(10) || chr(10) || text || chr(10), '' ORDER BY pos) AS text FROM r WHERE text <> '' GROUP BY book_id""",
        "single_beats_flat": f"{_BOOK} SELECT DISTINCT book_id, book_id || '_full_text.txt' AS rel_path FROM r WHERE text <> ''",
        "epub_spine": "SELECT conv_id AS book_id, turn + 1 AS pos, CASE WHEN turn % 5 = 4 THEN 'gone' ELSE 'i' END || turn AS item_id, CASE WHEN turn % 2 = 0 THEN 'no' ELSE 'yes' END AS linear FROM conversations",
        "epub_items": f"{_ARCHIVE} SELECT book_id, item_id, o || '/' || turn || '/' || name AS name, content, ord FROM n WHERE there",
        "epub_errors": f"{_ARCHIVE} SELECT book_id, item_id, o || '/' || turn || '/' || name AS name FROM n WHERE NOT there",
        "written_chapters": f"""{_READ}, q AS (SELECT *, row_number() OVER (PARTITION BY book_id, is_chapter ORDER BY pos) AS n FROM r)
            SELECT folder || CASE WHEN is_chapter THEN 'chapter_' || printf('%03d', n) || '.txt' ELSE 'non-chapters-files/' || {_OWN} END AS rel_path, text FROM q""",
        "written_flat": f"{_READ} SELECT folder || {_OWN} AS rel_path, text FROM r",
        "written_single": f"""{_READ} SELECT folder || book_id || '_full_text.txt' AS rel_path,
            string_agg(chr(10) || chr(10) || '===== ' || printf('%03d', pos) || ' ' || title || ' =====' || chr(10) || chr(10) || text || chr(10), '' ORDER BY pos) AS text FROM r GROUP BY book_id, folder""",
        "run_summary": _summary(*_SPLIT),
        "run_summary_flat": _summary(*_ALL, "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"),
        "run_summary_single": _summary(*_ALL, "CAST(NULL AS VARCHAR)", "CASE WHEN c > 0 THEN z.book_id || '_full_text.txt' END"),
        "empty_book": f"""WITH x AS ({_summary(*_SPLIT, blank=_HALF)})
            SELECT book_id, CAST(0 AS BIGINT) AS line_no, CASE WHEN chapter_count + non_chapter_count = 0 THEN 'No chapter text found. The EPUB may use an unsupported structure.' ELSE 'Wrote ' || chapter_count || ' chapter file(s) to output' END AS line FROM x
            UNION ALL SELECT book_id, 1, 'Wrote ' || non_chapter_count || ' non-chapter file(s) to output/non-chapters-files' FROM x WHERE non_chapter_count > 0""",
        "process_log": f"""{_BOOK} SELECT book_id, pos, '  [' || printf('%03d', pos) || '/' || printf('%03d', total) || '] ' || CASE WHEN text = '' THEN '(empty, skipped) "' || title || '"'
            ELSE CASE WHEN is_chapter THEN 'chapter' ELSE 'non-chapter' END || ': "' || title || '" (' || length(text) || ' chars)' END AS line FROM r""",
        "log_tags": f"""WITH y AS ({_summary(*_SPLIT)}),
            w AS ({_BOOK} SELECT book_id, '[' || printf('%03d', pos) || '/' || printf('%03d', total) || '] ' || CASE WHEN text = '' THEN '(empty, skipped) "' || t || '"'
              ELSE CASE WHEN is_chapter THEN 'chapter' ELSE 'non-chapter' END || ': "' || t || '" (' || length(text) || ' chars)' END AS line, CASE WHEN t = 'cancelled' THEN 'error' ELSE 'text' END AS tag
              FROM (SELECT *, CASE WHEN pos = 2 THEN 'cancelled' ELSE title END AS t FROM r))
            SELECT * FROM w
            UNION ALL SELECT book_id, 'Wrote ' || chapter_count || ' chapter file(s) to output', 'success' FROM y WHERE chapter_count + non_chapter_count > 0
            UNION ALL SELECT book_id, 'Wrote ' || non_chapter_count || ' non-chapter file(s) to output/non-chapters-files', 'success' FROM y WHERE non_chapter_count > 0
            UNION ALL SELECT book_id, 'No chapter text found. The EPUB may use an unsupported structure.', 'text' FROM y WHERE chapter_count + non_chapter_count = 0""",
        "unmatched_books": f"SELECT book_id, non_chapter_count AS n, {_HINT} AS hint FROM ({_summary(*_SPLIT)}) WHERE chapter_count = 0 AND non_chapter_count > 0",
        "progress_events": f"{_BOOK} SELECT book_id, pos, total, title, is_chapter, CAST(floor(CAST(pos AS DOUBLE) / total * 100) AS BIGINT) AS percent FROM r",
        "cancel_prefix": f"""{_BOOK}, e AS (SELECT book_id, count(*) AS events FROM r WHERE pos < 3 GROUP BY book_id), l AS (SELECT book_id, max(pos) AS m FROM s GROUP BY book_id)
            SELECT l.book_id, CAST(2 AS BIGINT) AS total_items, CAST(0 AS BIGINT) AS chapter_count, CAST(0 AS BIGINT) AS non_chapter_count, true AS cancelled, CAST(coalesce(events, 0) AS BIGINT) AS events
            FROM l LEFT JOIN e ON l.book_id = e.book_id WHERE m >= 3""",
        "duration_format": "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS elapsed FROM (SELECT event_id, CAST(event_id * 37 AS BIGINT) AS s FROM events)",
        "terminal_state": f"""SELECT book_id, CASE WHEN book_id % 5 = 0 THEN 'cancelled' WHEN chapter_count + non_chapter_count > 0 THEN 'completed' ELSE 'failed' END AS state
            FROM ({_summary(*_SPLIT, blank=_HALF)})""",
    }
