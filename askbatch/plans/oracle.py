"""DuckDB SQL for every registered query (the correctness oracle).

Each statement reads the same corpus views (`pages`, `documents`,
`benchmark`, `conversations`) and derives the same inputs as
`sources.derived`, then computes the operator in plain SQL. Rule tables
(markdown rules, anchor grammar, stop words) are shared with the Spark side
so both engines run identical patterns.
"""

from __future__ import annotations

from ..functions import links as L
from ..functions import text as T
from ..operators import exchange as X
from ..operators.retrieval import B, K1
from ..sources import derived as D
from . import catalog as C


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def strip_edges(x: str) -> str:
    return rr(x, T.EDGE_SPACE, "")


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), {q(T.TOKEN_SPLIT)}), lambda t_: t_ <> '')"


# The pages of the corpus hold these references, some of `&amp` cut short at
# the end of a page, and these tags only; the statements name them plainly.
REFERENCES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'))


def decode(x: str) -> str:
    for reference, character in REFERENCES:
        x = f"replace({x}, {q(reference)}, {q(character)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def quiet(x: str) -> str:
    """Without scripts, styles and comments."""
    return rr(x, r"(?is)<script[^>]*>.*?(?:</script\s*>|\z)|<style[^>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)", "")


def md_body(x: str) -> str:
    x = rr(rr(quiet(x), r"(?s)<head[^>]*>.*?</head>", ""), r"\s+", " ")
    for pattern, text in ((r"<h1[^>]*>", "\n\n# "), (r"</h1>", "\n\n"), (r"<li[^>]*>", "\n* "), (r"<br[^>]*>", "\n"),
                          (r"</?b>", "**"), (r"</?(?:p|div|article|nav|ul|body|html|footer|title)(?:\s[^>]*)?>", "\n\n"),
                          (r"</?[a-z][^>]*>|<![^>]*>", "")):
        x = rr(x, pattern, text)
    x = rr(rr(decode(x), r"[ \t]*\n[ \t]*", "\n"), r"\n\n\n+", "\n\n")
    return rr(x, r"^\s+|\s+$", "")


def md_doc(url: str, html: str) -> str:
    return f"('source: ' || {url} || ' ' || chr(10) || {md_body(html)} || chr(10) || chr(10))"


def collapse(x: str) -> str:
    return strip_edges(rr(x, r"\s+", " "))


def list_sql(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def first_occurrence(lst: str) -> str:
    return f"list_filter({lst}, lambda x_, i_: list_position({lst}, x_) = i_)"


def normalize(x: str) -> str:
    toks = tokens(rr(x, T.SITE_OPERATOR, " "))
    stop = list_sql(T.stop_words())
    kept = f"array_to_string(list_filter({first_occurrence(toks)}, lambda w_: NOT list_contains({stop}, w_)), ' ')"
    fb = f"array_to_string({first_occurrence(toks)}, ' ')"
    return f"(CASE WHEN {kept} <> '' THEN {kept} WHEN {fb} <> '' THEN {fb} ELSE {strip_edges(x)} END)"


def fill(template: str, **slots: str) -> str:
    import re
    parts, last = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(q(template[last:m.start()]))
        parts.append(slots[m.group(1)])
        last = m.end()
    parts.append(q(template[last:]))
    return "(" + " || ".join(parts) + ")"


def body(prompt: str) -> str:
    return (f"to_json({{'messages': [{{'role': {q(X.ROLE)}, 'content': {prompt}}}], "
            f"'model': {q(X.MODEL)}, 'temperature': {X.TEMPERATURE}}})::VARCHAR")


def rds(p: str) -> str:
    segs = f"string_split({p}, '/')"
    step = ("lambda acc_, s_: CASE WHEN s_ = '.' THEN acc_ WHEN s_ = '..' THEN "
            "(CASE WHEN len(acc_) > 1 OR (len(acc_) = 1 AND acc_[1] <> '') THEN acc_[1:len(acc_) - 1] "
            "ELSE acc_ END) ELSE list_append(acc_, s_) END")
    kept = f"list_reduce({segs}, {step}, []::VARCHAR[])"
    return (f"array_to_string(CASE WHEN {segs}[-1] IN ('.', '..') THEN list_append({kept}, '') "
            f"ELSE {kept} END, '/')")


def resolve_from(src: str, base: str, ref: str, cols: str) -> str:
    """SELECT {cols}, link_url FROM ({src}) resolving ref against base."""
    ux = q(L.URI_PARTS)
    parts = ", ".join(
        [f"regexp_extract({base}, {ux}, {i}) AS b{i}" for i in (1, 2, 3, 4)]
        + [f"regexp_extract({ref}, {ux}, {i}) AS r{i}" for i in (1, 2, 3, 4, 5)])
    merged = "(CASE WHEN b2 <> '' AND b3 = '' THEN '/' || r3 ELSE regexp_replace(b3, '[^/]*$', '') || r3 END)"
    target = (f"CASE WHEN rs <> '' THEN rs || r2 || {rds('r3')} || r4 "
              f"WHEN r2 <> '' THEN b1 || r2 || {rds('r3')} || r4 "
              f"WHEN r3 = '' THEN b1 || b2 || b3 || (CASE WHEN r4 <> '' THEN r4 ELSE b4 END) "
              f"WHEN starts_with(r3, '/') THEN b1 || b2 || {rds('r3')} || r4 "
              f"ELSE b1 || b2 || {rds(merged)} || r4 END")
    return (f"SELECT {cols}, CASE WHEN {ref} = '' THEN {base} ELSE ({target}) || r5 END AS link_url FROM ("
            f"SELECT *, CASE WHEN lower(r1) = lower(b1) AND r2 = '' THEN '' ELSE r1 END AS rs FROM ("
            f"SELECT *, {parts} FROM ({src})))")


def links_sql(pages_src: str = "SELECT url, html FROM pages") -> str:
    """Anchors of the corpus pages: `<a href="...">text</a>`."""
    href = strip_edges(decode("regexp_extract(piece, '^[^>]*href=\"([^\"]*)\"', 1)"))
    inner = collapse(decode("regexp_replace(regexp_extract(piece, '(?s)>(.*?)(?:</a>|\\z)', 1), '<[^>]*>', '', 'g')"))
    return f"""
    SELECT page_url, CAST(pos AS BIGINT) AS pos, {href} AS href,
           CASE WHEN {inner} = '' THEN 'Unnamed link' ELSE {inner} END AS text
    FROM (SELECT page_url, unnest(range(CAST(len(p_) AS BIGINT))) AS pos, unnest(p_) AS piece
          FROM (SELECT url AS page_url, string_split({quiet('html')}, '<a ')[2:] AS p_ FROM ({pages_src})))
    WHERE regexp_matches(piece, '^[^>]*href="[^"]*"[^>]*>')"""


def bm25(queries: str, corpus: str, k: int, mkt: bool = False) -> str:
    """Top-k (qid, rank, doc_id, score) of queries(qid, query[, lang]) over
    corpus(doc_id, text[, lang]); a query with a language ranks its documents."""
    q_lang, d_lang = (", lang AS ql", ", lang AS dl_") if mkt else ("", "")
    own = "WHERE qt_.ql IS NULL OR qt_.ql = po_.lang" if mkt else ""
    return f"""
    WITH d_ AS (SELECT doc_id, {tokens("coalesce(text, '')")} AS toks{d_lang} FROM ({corpus})),
    st_ AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM d_),
    po_ AS (SELECT doc_id, any_value(dl) AS doc_len, term, count(*) AS tf{", any_value(dl_) AS lang" if mkt else ""}
            FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term{", dl_" if mkt else ""} FROM d_) GROUP BY doc_id, term),
    qt_ AS (SELECT DISTINCT qid, unnest({tokens('query')}) AS term{q_lang} FROM ({queries})),
    df_ AS (SELECT term, count(*) AS df FROM po_ WHERE term IN (SELECT term FROM qt_) GROUP BY term),
    sc_ AS (SELECT qt_.qid, po_.doc_id,
                   sum(ln(1 + ((SELECT n_docs FROM st_) - df_.df + 0.5) / (df_.df + 0.5)) * po_.tf * {K1 + 1.0}
                       / (po_.tf + {K1} * ({1.0 - B} + {B} * po_.doc_len / (SELECT avg_len FROM st_)))) AS score
            FROM qt_ JOIN po_ USING (term) JOIN df_ USING (term) {own}
            GROUP BY qt_.qid, po_.doc_id),
    rk_ AS (SELECT qid, doc_id, score,
                   row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank
            FROM sc_)
    SELECT qid, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 4) AS score FROM rk_ WHERE rank <= {k}
    """


def relaxed(queries: str, corpus: str, k: int, rounds: int) -> str:
    """(qid, rank, doc_id, score, round) of conjunctive search with terms
    dropped by idf, then of any match."""
    return f"""
    WITH d_ AS (SELECT doc_id, {tokens("coalesce(text, '')")} AS toks FROM ({corpus})),
    st_ AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM d_),
    po_ AS (SELECT doc_id, any_value(dl) AS doc_len, term, count(*) AS tf
            FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d_) GROUP BY doc_id, term),
    df_ AS (SELECT term, count(*) AS df FROM po_ GROUP BY term),
    qt_ AS (SELECT qid, term, df, row_number() OVER (PARTITION BY qid ORDER BY df, term) AS nth,
                   count(*) OVER (PARTITION BY qid) AS terms
            FROM (SELECT DISTINCT qid, unnest({tokens('query')}) AS term FROM ({queries})) JOIN df_ USING (term)),
    pa_ AS (SELECT qid, doc_id, nth, terms, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * {K1 + 1.0}
                   / (tf + {K1} * ({1.0 - B} + {B} * doc_len / avg_len)) AS part FROM qt_ JOIN po_ USING (term), st_),
    le_ AS (SELECT qid, doc_id, any_value(terms) AS terms, list({{'nth': nth, 'part': part}} ORDER BY nth) AS g
            FROM pa_ GROUP BY qid, doc_id),
    ro_ AS (SELECT *, len(list_filter(g, lambda x, i: x.nth = i)) AS lead FROM le_),
    sc_ AS (SELECT *, CASE WHEN terms - lead <= {rounds} THEN terms - lead + 1 ELSE {rounds} + 2 END AS round FROM ro_),
    va_ AS (SELECT qid, doc_id, round, coalesce(list_sum([x.part for x in CASE WHEN round = {rounds} + 2 THEN g ELSE g[1:lead] END]), 0) AS score
            FROM sc_),
    rk_ AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round, round(score, 6) DESC, doc_id) AS rank,
                   min(round) OVER (PARTITION BY qid) AS first FROM va_)
    SELECT qid, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 4) AS score, CAST(round AS BIGINT) AS round
    FROM rk_ WHERE rank <= {k} AND round = first
    """


# ---- derived inputs ---------------------------------------------------------

QUESTIONS = (f"SELECT CAST(conv_id * {D.TURN_BASE} + turn AS BIGINT) AS question_id, text AS question "
             f"FROM conversations WHERE role = 'user'")
QA = (f"SELECT CAST(u.conv_id * {D.TURN_BASE} + u.turn AS BIGINT) AS question_id, u.text AS question, "
      f"a.text AS answer FROM conversations u JOIN conversations a "
      f"ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
TWICE_ASKED = f"{QUESTIONS} UNION ALL SELECT -1 - question_id, question FROM ({QUESTIONS})"
MEMO = (f"SELECT question, 'draft: ' || answer AS answer, 1704067200 + question_id AS stored_ts FROM ({QA}) UNION ALL "
        f"SELECT question, answer, 1704067201 + question_id FROM ({QA}) UNION ALL "
        f"SELECT question, '', 1704067202 + question_id FROM ({QA}) WHERE question_id % 7 = 3")

GOOD_SEARCHES = f"""
SELECT question_id, 200 AS status, to_json({{'webPages': {{'value': list(v ORDER BY page_id)}}}})::VARCHAR AS body
FROM (SELECT CAST(page_id // {D.RESULTS_PER_SEARCH} AS BIGINT) AS question_id, page_id,
             {{'id': 'page-' || CAST(page_id AS VARCHAR),
               'name': regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
               'url': url,
               'snippet': {strip_edges("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}}} AS v
      FROM pages)
GROUP BY question_id
"""
SEARCHES = f"""
SELECT question_id, status, body FROM ({GOOD_SEARCHES})
UNION ALL
SELECT -1 - question_id, CASE WHEN question_id % 8 = 4 THEN 503 ELSE 200 END,
       CASE question_id % 8 WHEN 5 THEN '{{' || body WHEN 6 THEN '{{}}' WHEN 7 THEN '{{"webPages":{{}}}}' END
FROM ({GOOD_SEARCHES}) WHERE question_id % 8 >= 4
"""

SEARCH_REASON = f"""
CASE WHEN status IS NULL OR status <> 200 THEN 'http_status'
     WHEN body IS NULL OR NOT json_valid(body) THEN 'bad_json'
     WHEN json(jb_)::VARCHAR IN ('{{}}', '[]', 'null', 'false', '0', '""') THEN 'empty_response'
     WHEN json_extract(jb_, '$.webPages') IS NULL THEN 'no_webPages'
     WHEN json_extract(jb_, '$.webPages.value') IS NULL
          OR json_type(json_extract(jb_, '$.webPages.value')) <> 'ARRAY' THEN 'no_value'
END"""
GUARDED_SEARCHES = "SELECT *, CASE WHEN json_valid(body) THEN body END AS jb_ FROM (" + SEARCHES + ")"

RESULTS = f"""
SELECT question_id, CAST(pos AS BIGINT) AS pos, json_extract_string(item, '$.id') AS id,
       json_extract_string(item, '$.name') AS name, json_extract_string(item, '$.url') AS url,
       json_extract_string(item, '$.snippet') AS snippet
FROM (SELECT question_id, unnest(json_extract(body, '$.webPages.value[*]')) AS item,
             unnest(range(CAST(json_array_length(json_extract(body, '$.webPages.value')) AS BIGINT))) AS pos
      FROM (SELECT question_id, CASE WHEN {SEARCH_REASON} IS NULL THEN jb_ END AS body FROM ({GUARDED_SEARCHES}))
      WHERE body IS NOT NULL)
"""

SNAPSHOT = "SELECT page_id, url, html, 200 AS status FROM pages"
FAILING_SNAPSHOT = (f"{SNAPSHOT} UNION ALL SELECT -1 - page_id, url || '?gone', '<p>gone</p>', 404 "
                    f"FROM pages WHERE page_id % 7 = 2")
FAILING_RESULTS = ("SELECT -1 - page_id AS question_id, CAST(0 AS BIGINT) AS pos, "
                   "url || CASE WHEN page_id % 7 = 2 THEN '?gone' ELSE '?missing' END AS url "
                   "FROM pages WHERE page_id % 7 IN (2, 5)")
ALL_RESULTS = f"SELECT question_id, pos, url FROM ({RESULTS}) UNION ALL {FAILING_RESULTS}"


def fetch_pick(results: str, snapshot: str) -> str:
    """One candidate per result (highest page_id; none -> nulls)."""
    return f"""
    SELECT r.question_id, r.pos, r.url, s.html, s.status FROM ({results}) r
    LEFT JOIN ({snapshot}) s ON s.url = r.url
    QUALIFY row_number() OVER (PARTITION BY r.question_id, r.pos ORDER BY s.page_id DESC NULLS LAST) = 1
    """


FETCHED = f"SELECT question_id, pos, url, html FROM ({fetch_pick(ALL_RESULTS, FAILING_SNAPSHOT)}) WHERE html IS NOT NULL AND status = 200"
FETCH_FAILURES = f"""
SELECT question_id, 'fetch' AS stage, url AS key,
       CASE WHEN status IS NULL THEN 'not_fetched' ELSE 'http_status ' || CAST(status AS VARCHAR) END AS reason
FROM ({fetch_pick(ALL_RESULTS, FAILING_SNAPSHOT)}) WHERE NOT (html IS NOT NULL AND status = 200)
"""
SEARCH_FAILURES = f"""
SELECT question_id, 'search' AS stage,
       CASE WHEN reason = 'http_status' THEN CAST(status AS VARCHAR) END AS key, reason
FROM (SELECT question_id, status, {SEARCH_REASON} AS reason FROM ({GUARDED_SEARCHES})) WHERE reason IS NOT NULL
"""


def chat(x: str) -> str:
    return f"to_json({{'choices': [{{'message': {{'content': {x}}}}}]}})::VARCHAR"


PAGE_LINES = f"""
SELECT *, ((question_id % 1000) + pos) % 9 AS c_
FROM (SELECT question_id, unnest(string_split(answer, chr(10))) AS line,
             unnest(range(CAST(len(string_split(answer, chr(10))) AS BIGINT))) AS pos FROM ({QA}))
"""
PAGE_RESPONSES = f"""
SELECT 'page:' || CAST(question_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) AS request_id, 200 AS status,
       {chat('line')} AS body FROM ({PAGE_LINES})
UNION ALL
SELECT 'page:' || CAST(-1 - question_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR), CASE WHEN c_ = 4 THEN 500 ELSE 200 END,
       CASE c_ WHEN 7 THEN '{{"choices":[]}}' WHEN 8 THEN '{{' || {chat('line')} END
FROM ({PAGE_LINES}) WHERE c_ IN (4, 7, 8)
"""


def replies(kind: str, content: str, case: int, status: int) -> str:
    return f"""
    SELECT '{kind}:' || CAST(question_id AS VARCHAR) AS request_id, 200 AS status, {chat(content)} AS body FROM ({QA})
    UNION ALL
    SELECT '{kind}:' || CAST(-1 - question_id AS VARCHAR), {status}, NULL FROM ({QA}) WHERE (question_id % 1000) % 5 = {case}
    """


FINAL_RESPONSES = replies("final", "answer", 3, 500)


def parsed(src: str) -> str:
    return f"""
    SELECT request_id, split_part(request_id, ':', 1) AS kind,
           TRY_CAST(split_part(request_id, ':', 2) AS BIGINT) AS question_id,
           TRY_CAST(NULLIF(split_part(request_id, ':', 3), '') AS BIGINT) AS pos,
           json_extract_string(jb_, '$.choices[0].message.content') AS content,
           CASE WHEN status IS NULL OR status <> 200 THEN 'http_status'
                WHEN body IS NULL OR NOT json_valid(body) THEN 'bad_json' END AS r0_
    FROM (SELECT *, CASE WHEN json_valid(body) THEN body END AS jb_ FROM ({src}))
    """


def parse_ok(src: str) -> str:
    return f"SELECT request_id, kind, question_id, pos, content FROM ({parsed(src)}) WHERE r0_ IS NULL AND content IS NOT NULL"


def parse_fail(src: str) -> str:
    return (f"SELECT question_id, 'model' AS stage, request_id AS key, coalesce(r0_, 'no_content') AS reason "
            f"FROM ({parsed(src)}) WHERE r0_ IS NOT NULL OR content IS NULL")


RESPONSES = f"{PAGE_RESPONSES} UNION ALL {FINAL_RESPONSES}"
PAGE_ANSWERS = f"""
SELECT question_id, list(content ORDER BY pos) AS answers, count(*) AS n_answers
FROM ({parse_ok(PAGE_RESPONSES)}) GROUP BY question_id
"""


def requests(kind: str, src: str, prompt: str, pos: str | None) -> str:
    rid = f"'{kind}:' || CAST(question_id AS VARCHAR)" + (f" || ':' || CAST({pos} AS VARCHAR)" if pos else "")
    return (f"SELECT {rid} AS request_id, CAST(question_id AS BIGINT) AS question_id, '{kind}' AS kind, "
            f"CAST({pos if pos else 'NULL'} AS BIGINT) AS pos, {body(prompt)} AS body FROM ({src})")


def latest_memo(src: str) -> str:
    return (f"SELECT question, answer, stored_ts FROM ({src}) "
            f"QUALIFY row_number() OVER (PARTITION BY question ORDER BY stored_ts DESC, answer DESC) = 1")


def lookup(questions: str, memo: str) -> str:
    found = (f"SELECT question, answer FROM ({latest_memo(memo)}) "
             f"WHERE question IN (SELECT question FROM ({questions})) AND answer <> ''")
    return f"SELECT q_.*, f_.answer FROM ({questions}) q_ LEFT JOIN ({found}) f_ ON f_.question = q_.question"


def page_corpus() -> str:
    return f"SELECT page_id AS doc_id, {md_doc('url', 'html')} AS text FROM pages"


def ranked_page_results(questions: str) -> str:
    """`questions(question_id, question, query)` -> (question_id, pos, url):
    the top-5 pages by BM25 over the markdown of `pages`."""
    top = bm25(f"SELECT question_id AS qid, query FROM ({questions})", page_corpus(), 5)
    results = (f"SELECT t.qid AS question_id, CAST(t.rank - 1 AS BIGINT) AS pos, p.url "
               f"FROM ({top}) t JOIN pages p ON p.page_id = t.doc_id")
    return results


# ---- statements -------------------------------------------------------------

def _stage_counts() -> str:
    fails = f"{SEARCH_FAILURES} UNION ALL {FETCH_FAILURES}"
    return f"""
    SELECT s.question_id, coalesce(r.n, 0) AS n_results, coalesce(f.n, 0) AS n_fetched,
           coalesce(x.n, 0) AS n_failures
    FROM (SELECT question_id FROM ({SEARCHES}) UNION SELECT question_id FROM ({ALL_RESULTS})) s
    LEFT JOIN (SELECT question_id, count(*) AS n FROM ({ALL_RESULTS}) GROUP BY 1) r USING (question_id)
    LEFT JOIN (SELECT question_id, count(*) AS n FROM ({FETCHED}) GROUP BY 1) f USING (question_id)
    LEFT JOIN (SELECT question_id, count(*) AS n FROM ({fails}) GROUP BY 1) x USING (question_id)
    """


def _memo_store() -> str:
    new = f"SELECT question, answer, 1717200000 AS stored_ts FROM ({QA}) WHERE contains(answer, chr(10))"
    return f"SELECT question, answer, CAST(stored_ts AS BIGINT) AS stored_ts FROM ({latest_memo(f'{MEMO} UNION ALL {new}')})"


GENERATED = """
SELECT 'user:' || CAST(c_custkey AS VARCHAR) AS question,
       to_json({'name': c_name, 'email': lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '.', 'g')) || '@example.com',
                'address': c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR),
                'phone_number': '555-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')})::VARCHAR AS answer FROM customer
"""


def _values(rows, cols: str) -> str:
    def v(x):
        if x is None:
            return "NULL"
        return str(x) if isinstance(x, int) else q(x)
    body = ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({cols})"


def _resolve_links() -> str:
    src = (f"SELECT page_url, href FROM ({links_sql()}) UNION ALL "
           f"{_values(C.URL_CASES, 'page_url, href')}")
    return f"SELECT DISTINCT * FROM ({resolve_from(src, 'page_url', 'href', 'page_url, href')})"


def _find_pdf_links() -> str:
    pages = "SELECT url, regexp_replace(html, 'href=\"(/d[^\"]*)\"', 'href=\"\\1.PDF\"', 'g') AS html FROM pages"
    pdf = f"SELECT page_url, href FROM ({links_sql(pages)}) WHERE ends_with(lower(href), '.pdf')"
    return f"SELECT DISTINCT page_url, link_url FROM ({resolve_from(pdf, 'page_url', 'href', 'page_url')})"


def _extract_passages() -> str:
    top = bm25("SELECT item_id AS qid, text AS query FROM benchmark",
               "SELECT doc_id, text FROM documents", 5)
    return f"""
    WITH pairs AS (SELECT t.qid, t.doc_id, d.text FROM ({top}) t JOIN documents d USING (doc_id)),
    qt AS (SELECT item_id AS qid, list_distinct({tokens('text')}) AS q_terms FROM benchmark),
    lines AS (SELECT qid, doc_id, unnest(string_split(text, chr(10))) AS line,
                     unnest(range(CAST(len(string_split(text, chr(10))) AS BIGINT))) AS line_no FROM pairs),
    sc AS (SELECT l.qid, l.doc_id, l.line_no, l.line,
                  len(list_intersect(list_distinct({tokens('l.line')}), qt.q_terms)) AS overlap
           FROM lines l JOIN qt USING (qid)),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY overlap DESC, line_no) AS rn
          FROM sc WHERE overlap > 0)
    SELECT qid, doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(overlap AS BIGINT) AS overlap,
           line AS passage FROM r WHERE rn <= 1
    """


def _build_requests_page() -> str:
    qs = "SELECT item_id AS question_id, text AS question, text AS query FROM benchmark"
    results = ranked_page_results(qs)
    fetched = (f"SELECT question_id, pos, url, html FROM ({fetch_pick(results, 'SELECT page_id, url, html, 200 AS status FROM pages')}) "
               f"WHERE html IS NOT NULL AND status = 200")
    src = (f"SELECT f.question_id, f.pos, {md_doc('f.url', 'f.html')} AS markdown, b.text AS question "
           f"FROM ({fetched}) f JOIN benchmark b ON b.item_id = f.question_id")
    return requests(X.KIND_PAGE, src, fill(X.PAGE_PROMPT, question="question", page="markdown"), "pos")


def _prepare_answers() -> str:
    valid = f"SELECT * FROM ({QUESTIONS}) WHERE NOT (question IS NULL OR {strip_edges('question')} = '')"
    misses = (f"SELECT question_id, question FROM ({lookup(valid, MEMO)}) WHERE answer IS NULL")
    qs = f"SELECT question_id, question, {normalize('question')} AS query FROM ({misses})"
    results = ranked_page_results(qs)
    fetched = f"SELECT question_id, pos, url, html FROM ({fetch_pick(results, SNAPSHOT)}) WHERE html IS NOT NULL AND status = 200"
    src = (f"SELECT f.question_id, f.pos, {md_doc('f.url', 'f.html')} AS markdown, m.question "
           f"FROM ({fetched}) f JOIN ({misses}) m USING (question_id)")
    return requests(X.KIND_PAGE, src, fill(X.PAGE_PROMPT, question="question", page="markdown"), "pos")


def _page_requests(picked: str, questions: str) -> str:
    src = (f"SELECT f.question_id, f.pos, {md_doc('f.url', 'f.html')} AS markdown, m.question "
           f"FROM ({picked}) f JOIN ({questions}) m USING (question_id) WHERE f.html IS NOT NULL AND f.status = 200")
    return requests(X.KIND_PAGE, src, fill(X.PAGE_PROMPT, question="question", page="markdown"), "pos")


SEARCHED = f"SELECT question_id, 'question ' || CAST(question_id AS VARCHAR) AS question FROM ({SEARCHES})"
# every fourth question is stored, every other of these with an empty answer
SEARCHED_MISSES = (f"SELECT * FROM ({SEARCHED}) WHERE ((question_id % 4) + 4) % 4 <> 1 OR ((question_id % 8) + 8) % 8 = 5")


def _prepare_from_searches(failures: bool) -> str:
    asked = f"question_id IN (SELECT question_id FROM ({SEARCHED_MISSES}))"
    picked = fetch_pick(f"SELECT question_id, pos, url FROM ({RESULTS}) WHERE {asked}", FAILING_SNAPSHOT)
    if not failures:
        return _page_requests(picked, SEARCHED_MISSES)
    return f"""
    SELECT * FROM ({SEARCH_FAILURES}) WHERE {asked}
    UNION ALL SELECT question_id, 'fetch', url,
        CASE WHEN status IS NULL THEN 'not_fetched' ELSE 'http_status ' || CAST(status AS VARCHAR) END
    FROM ({picked}) WHERE NOT (html IS NOT NULL AND status = 200)"""


def _finish_new() -> str:
    """Questions that the filled memo does not answer."""
    return f"SELECT question_id, question FROM ({lookup(TWICE_ASKED, MEMO)}) WHERE answer IS NULL"


def _finish_memo() -> str:
    finals = f"SELECT question_id, max(content) AS answer FROM ({parse_ok(FINAL_RESPONSES)}) WHERE kind = 'final' GROUP BY 1"
    new = f"SELECT n.question, f.answer FROM ({_finish_new()}) n JOIN ({finals}) f USING (question_id)"
    return (f"SELECT question, answer FROM ({latest_memo(MEMO)}) WHERE question NOT IN (SELECT question FROM ({new})) "
            f"UNION ALL SELECT question, max(answer) FROM ({new}) GROUP BY 1")


def _finish_requests() -> str:
    src = (f"SELECT q.question_id, q.question, coalesce(a.answers, []::VARCHAR[]) AS answers "
           f"FROM ({_finish_new()}) q LEFT JOIN ({PAGE_ANSWERS}) a USING (question_id)")
    prompt = fill(X.FINAL_PROMPT, question="question", answers="to_json(answers)::VARCHAR")
    return requests(X.KIND_FINAL, src, prompt, None)


def _build_requests_final() -> str:
    src = (f"SELECT q.question_id, q.question, coalesce(a.answers, []::VARCHAR[]) AS answers "
           f"FROM ({QUESTIONS}) q LEFT JOIN ({PAGE_ANSWERS}) a USING (question_id)")
    prompt = fill(X.FINAL_PROMPT, question="question", answers="to_json(answers)::VARCHAR")
    return requests(X.KIND_FINAL, src, prompt, None)


def _finish_answers() -> str:
    finals = (f"SELECT question_id, content AS answer FROM ({parse_ok(FINAL_RESPONSES)}) WHERE kind = 'final'")
    return f"""
    SELECT q.question_id, q.question, f.answer, CAST(coalesce(a.n_answers, 0) AS BIGINT) AS n_pages
    FROM ({TWICE_ASKED}) q JOIN ({finals}) f USING (question_id)
    LEFT JOIN ({PAGE_ANSWERS}) a USING (question_id)
    """


def _refine_search() -> str:
    q_all = "SELECT item_id AS qid, text AS query FROM benchmark"
    lang = C.REFINE_FIRST_MKT.split("-")[0]
    r1 = bm25(q_all, f"SELECT doc_id, text FROM documents WHERE lang = {q(lang)}", 5)
    good = f"SELECT qid FROM ({r1}) GROUP BY qid HAVING max(score) >= {C.REFINE_MIN_SCORE}"
    pend = f"SELECT * FROM ({q_all}) WHERE qid NOT IN ({good})"
    r2 = bm25(pend, "SELECT doc_id, text FROM documents", 5)
    return (f"SELECT qid, rank, doc_id, score, CAST(1 AS BIGINT) AS round FROM ({r1}) WHERE qid IN ({good}) "
            f"UNION ALL SELECT qid, rank, doc_id, score, CAST(2 AS BIGINT) AS round FROM ({r2})")


def _format_queries() -> str:
    env = replies("format", normalize("question"), 1, 502)
    good = f"SELECT question_id, max(content) AS rw FROM ({parse_ok(env)}) WHERE kind = 'format' GROUP BY 1"
    return (f"SELECT q.question_id, coalesce(g.rw, q.question) AS query FROM ({TWICE_ASKED}) q "
            f"LEFT JOIN ({good}) g USING (question_id)")


def statements() -> dict[str, str]:
    blanks = _values(C.BLANK_QUESTIONS, "question_id, question")
    sites = _values(C.SITE_QUESTIONS, "question_id, question")
    return {
        "scan_search_responses": RESULTS,
        "fetch_join": FETCHED,
        "fetch_failures": FETCH_FAILURES,
        "memo_store": _memo_store(),
        "generate_entries": GENERATED,
        "valid_questions": (f"SELECT question_id, question FROM ({QUESTIONS} UNION ALL {blanks}) "
                            f"WHERE NOT (question IS NULL OR {strip_edges('question')} = '')"),
        "search_failures": SEARCH_FAILURES,
        "parse_responses": parse_ok(RESPONSES),
        "response_failures": parse_fail(RESPONSES),
        "normalize_query": (f"SELECT question_id, {normalize('question')} AS query "
                            f"FROM ({QUESTIONS} UNION ALL {sites})"),
        "memo_hits": (f"SELECT question_id, question, answer FROM ({lookup(QUESTIONS, MEMO)}) "
                      f"WHERE answer IS NOT NULL"),
        "memo_misses": f"SELECT question_id, question FROM ({lookup(QUESTIONS, MEMO)}) WHERE answer IS NULL",
        "memo_exists": (f"SELECT q.question_id, q.question, q.question IN (SELECT question FROM ({MEMO})) AS \"exists\" "
                        f"FROM ({QUESTIONS}) q"),
        "memo_delete": (f"SELECT question, answer FROM ({latest_memo(MEMO)}) WHERE question NOT IN "
                        f"(SELECT text FROM conversations WHERE role = 'user' AND turn = 0)"),
        "collect_page_answers": (f"SELECT question_id, to_json(answers)::VARCHAR AS answers_json, "
                                 f"CAST(n_answers AS BIGINT) AS n_answers FROM ({PAGE_ANSWERS})"),
        "assemble_document": ("SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn) AS text, "
                              "CAST(count(*) AS BIGINT) AS n_pages FROM conversations GROUP BY conv_id"),
        "results_listing": (f"SELECT question_id, string_agg(coalesce(id, '') || chr(10) || coalesce(name, '') "
                            f"|| chr(10) || coalesce(url, '') || chr(10) || coalesce(snippet, '') || chr(10) "
                            f"|| chr(10), '' ORDER BY pos) AS listing, CAST(count(*) AS BIGINT) AS n_results "
                            f"FROM ({RESULTS}) GROUP BY question_id"),
        "memo_size": f"SELECT CAST(count(DISTINCT question) AS BIGINT) AS n_keys FROM ({MEMO})",
        "stage_counts": _stage_counts(),
        "failure_counts": (f"SELECT stage, reason, count(*) AS n FROM ({SEARCH_FAILURES} UNION ALL "
                           f"{FETCH_FAILURES} UNION ALL {parse_fail(RESPONSES)}) GROUP BY stage, reason"),
        "retrieve_topk": bm25("SELECT item_id AS qid, text AS query FROM benchmark",
                              "SELECT doc_id, text FROM documents", 5),
        "retrieve_topk_pruned": bm25("SELECT item_id AS qid, text AS query FROM benchmark",
                                     "SELECT doc_id, text FROM documents", 5),
        "retrieve_by_market": bm25("SELECT item_id AS qid, text AS query, ['en', 'fr', NULL, 'de', 'es'][item_id % 5 + 1] AS lang "
                                   "FROM benchmark", "SELECT doc_id, text, lang FROM documents", 5, mkt=True),
        "distinct_links": (f"SELECT DISTINCT page_url, link_url FROM "
                           f"({resolve_from(links_sql(), 'page_url', 'href', 'page_url')})"),
        "memo_flush": f"SELECT CAST(count(DISTINCT question) AS BIGINT) AS n_before, CAST(0 AS BIGINT) AS n_after FROM ({MEMO})",
        "build_requests_format": requests(X.KIND_FORMAT, QUESTIONS, fill(X.FORMAT_PROMPT, question="question"), None),
        "build_requests_page": _build_requests_page(),
        "build_requests_final": _build_requests_final(),
        "html_to_markdown": f"SELECT page_id, url, {md_doc('url', 'html')} AS markdown FROM pages",
        "find_pdf_links": _find_pdf_links(),
        "resolve_links": _resolve_links(),
        "extract_links": links_sql(),
        "extract_passages": _extract_passages(),
        "prepare_answers": _prepare_answers(),
        "prepare_hits": (f"SELECT question_id, question, answer FROM ({lookup(QUESTIONS, MEMO)}) WHERE answer IS NOT NULL"),
        "prepare_failures": _prepare_from_searches(failures=True),
        "prepare_from_searches": _prepare_from_searches(failures=False),
        "finish_answers": _finish_answers(),
        "finish_requests": _finish_requests(),
        "finish_memo": _finish_memo(),
        "refine_search": _refine_search(),
        "relaxed_search": relaxed("SELECT item_id AS qid, text AS query FROM benchmark",
                                  "SELECT doc_id, text FROM documents", 5, 20),
        "pdf_link_counts": (f"SELECT page_url, count(DISTINCT link_url) AS n_links FROM ({_find_pdf_links()}) "
                            f"GROUP BY page_url"),
        "format_queries": _format_queries(),
    }
