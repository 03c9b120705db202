"""DuckDB SQL for the registered queries, written against the raw tables.

``_with(names, body)`` puts the named table definitions in front of a query.
"""

from __future__ import annotations

_REFS = """CASE WHEN {n} % 2 <> 0 AND {n} % 3 <> 0 AND {n} % 5 <> 0 THEN ['refs/heads/feature/b']
  ELSE list_filter([CASE WHEN {n} % 2 = 0 THEN 'refs/heads/master' END,
    CASE WHEN {n} % 3 = 0 THEN 'refs/heads/develop' END,
    CASE WHEN {n} % 5 = 0 THEN 'refs/heads/feature/a' END], lambda x: x IS NOT NULL) END"""

MANY_WORDS = (
    "a an and anea are as at be ble by ea ed en er erin eron es for from ha he in ing is it ly nd nt of on or ou re sh "
    "st th than that thble the thea thed then ther thes thha thhe thin this thly thnd thnt thon thor thou thre thst thth "
    "thti thtion ti tion to was wh with"
).split()

_NORMAL = "replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _linecount(c: str) -> str:
    n = _NORMAL.format(c=c)
    return (f"CAST(len(string_split({n}, chr(10))) - CASE WHEN {c} = '' OR ends_with({n}, chr(10)) "
            "THEN 1 ELSE 0 END AS INTEGER)")


def _charcount(c: str) -> str:
    return f"CAST(length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS INTEGER)"


_FILE_COLUMNS = f"""project || '^' || repository || '^' || blob || '^:/' || path AS doc_id,
  project, repository, refs, blob, path, lower(regexp_extract(path, '\\.([^./\\\\]*)$', 1)) AS extension, contents,
  {_charcount('contents')} AS charcount, {_linecount('contents')} AS linecount"""

_LINES = """CASE WHEN rtrim(contents, chr(10) || chr(13)) = '' AND contents <> '' THEN []::VARCHAR[]
  ELSE string_split(%s, chr(10)) END""" % _NORMAL.format(c="rtrim(contents, chr(10) || chr(13))")


def _tokens(c: str, separator: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({c}, '{separator}'), lambda t: lower(t)), "
            "lambda t: t <> '')")


CODE, PATH, MESSAGE = "[^A-Za-z0-9_]+", "[/\\\\.]", "[^\\p{L}\\p{N}_]+"

_EVENT_PLACE = """['en','fr','de','es'][event_id % 4 + 1] AS project,
  'src' || CAST((event_id // 4) % 20 AS VARCHAR) AS repository"""

TABLES = {
    "docs0": f"""SELECT doc_id AS n, lang AS project, source AS repository, {_REFS.format(n='doc_id')} AS refs,
      lang || '/' || source || '/doc_' || CAST(doc_id AS VARCHAR)
        || ['.py','.java','.md','.txt','.sql',''][doc_id % 6 + 1] AS path, text AS contents
      FROM documents""",
    "files": f"SELECT {_FILE_COLUMNS} FROM (SELECT *, sha1(contents) AS blob FROM docs0)",
    "pagefiles": f"""SELECT {_FILE_COLUMNS} FROM (SELECT 'web' AS project,
      regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS repository, ['refs/heads/master'] AS refs,
      sha1(html) AS blob, url AS path, html AS contents FROM pages)""",
    "allfiles": "SELECT * FROM files UNION ALL SELECT * FROM pagefiles",
    "commits": f"""SELECT project || '^' || repository || '^' || hash AS doc_id, * FROM (
      SELECT {_EVENT_PLACE}, {_REFS.format(n='event_id')} AS refs, sha1(CAST(event_id AS VARCHAR)) AS hash,
      ts AS commitdate, 'User ' || CAST(user_id AS VARCHAR) AS authorname,
      'user' || CAST(user_id AS VARCHAR) || '@example.com' AS authoremail, event_type AS subject, props AS body
      FROM events)""",
    "talk": """SELECT 'talk^log^' || hash AS doc_id, * FROM (
      SELECT 'talk' AS project, 'log' AS repository, ['refs/heads/master'] AS refs,
      sha1(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)) AS hash, CAST(NULL AS TIMESTAMP) AS commitdate,
      role AS authorname, '' AS authoremail, split_part(text, chr(10), 1) AS subject,
      CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS body
      FROM conversations)""",
    "docs": """SELECT 'file' AS doc_type, doc_id, project, repository, refs, path, extension, contents, charcount,
      linecount, NULL AS subject, NULL AS authorname, NULL AS authoremail, NULL AS commitdate, NULL AS body FROM files
      UNION ALL SELECT 'commit', doc_id, project, repository, refs, NULL, NULL, NULL, NULL, NULL, subject, authorname,
      authoremail, commitdate, body FROM commits""",
    "repos": """SELECT DISTINCT lang AS project, source AS repository, upper(lang) AS projectname,
      upper(source) AS repositoryname, 'refs/heads/master' AS default_branch,
      'HEAD|(refs/heads/(master|develop))' AS ref_regex FROM documents""",
    "grants": """SELECT project, repository,
      CAST(CAST(regexp_extract(repository, '[0-9]+$') AS BIGINT) % 5 AS VARCHAR) AS user_id FROM repos""",
    "branches": """SELECT project, repository, ref, sha1(max(blob) || '^' || CAST(count(*) AS VARCHAR)) AS tip
      FROM (SELECT project, repository, unnest(refs) AS ref, blob FROM files) GROUP BY ALL""",
    "oldtree": "SELECT project, repository, unnest(refs) AS ref, path, sha1(contents) AS blob, contents FROM docs0",
    "newdocs": """SELECT project, repository, refs, CASE WHEN project = 'es' THEN 'moved/' || path ELSE path END AS path,
      CASE WHEN project = 'de' THEN contents || ' x' ELSE contents END AS contents FROM docs0
      WHERE n NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
      UNION ALL SELECT project, repository, refs, path, contents FROM pagefiles""",
    "newtree": "SELECT project, repository, unnest(refs) AS ref, path, sha1(contents) AS blob, contents FROM newdocs",
    "blobs": """SELECT DISTINCT sha1(contents) AS blob, contents FROM (
      SELECT contents FROM docs0 UNION ALL SELECT contents FROM newdocs)""",
    "reach0": f"""SELECT {_EVENT_PLACE}, unnest({_REFS.format(n='event_id')}) AS ref,
      sha1(CAST(event_id AS VARCHAR)) AS hash, ts, event_type FROM events""",
    "oldreach": "SELECT project, repository, ref, hash FROM reach0 WHERE ts < TIMESTAMP '2024-01-20'",
    "newreach": "SELECT project, repository, ref, hash FROM reach0 WHERE event_type <> 'error'",
    "refevents": f"""SELECT event_id, ts, {_EVENT_PLACE},
      ['refs/heads/master','refs/heads/develop','refs/heads/feature/a','refs/heads/feature/b'][event_id % 4 + 1] AS ref,
      CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS change_type
      FROM events""",
    "toks": f"""SELECT doc_id, {_tokens('contents', CODE)} AS c, {_tokens('path', PATH)} AS p, path, contents,
      project, repository, extension, charcount, linecount, refs FROM files""",
    "words": """SELECT doc_id, 'contents' AS field, unnest(c) AS term, generate_subscripts(c, 1) - 1 AS pos FROM toks
      UNION ALL SELECT doc_id, 'path', unnest(p), generate_subscripts(p, 1) - 1 FROM toks""",
    "lines": f"""SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no, forms FROM (
      SELECT doc_id, {_LINES} AS l, list_slice(f, 1, 50) AS forms FROM (
        SELECT doc_id, contents, list_distinct_ordered AS f FROM forms))""",
}
_NEEDS = {
    "files": ["docs0"], "allfiles": ["files", "pagefiles"], "docs": ["files", "commits"], "grants": ["repos"],
    "branches": ["files"], "oldtree": ["docs0"], "newdocs": ["docs0", "pagefiles"], "newtree": ["newdocs"],
    "blobs": ["docs0", "newdocs"], "oldreach": ["reach0"], "newreach": ["reach0"], "toks": ["files"],
    "words": ["toks"], "lines": ["forms"], "forms": ["files"],
    "picked": ["lines"], "shown": ["picked"],
}


def _forms(test: str) -> str:
    """Surface forms per document: distinct tokens as written, by first position."""
    split = f"string_split_regex(contents, '{CODE}')"
    return f"""SELECT doc_id, contents, coalesce(f, []::VARCHAR[]) AS list_distinct_ordered FROM files LEFT JOIN (
      SELECT doc_id AS d, list(t ORDER BY first_at) AS f FROM (
        SELECT doc_id, t, min(i) AS first_at FROM (
          SELECT doc_id, unnest({split}) AS t, generate_subscripts({split}, 1) AS i FROM files)
        WHERE t <> '' AND {test} GROUP BY doc_id, t) GROUP BY doc_id) ON d = doc_id"""


TABLES["forms"] = _forms("lower(t) = 'this'")

# Line selection written with windows over exploded lines: context 1, preview 10, limit 50.
TABLES["picked"] = """SELECT *, max(m) OVER (PARTITION BY doc_id) AS any_m, count(*) OVER (PARTITION BY doc_id) AS n_lines,
    max(m) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS inside,
    lead(m, 2, 0) OVER (PARTITION BY doc_id ORDER BY no) AS ahead,
    coalesce(max(m) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS before
  FROM (SELECT doc_id, no, line, CASE WHEN len(list_filter(forms, lambda f: contains(line, f))) > 0 THEN 1 ELSE 0 END AS m
    FROM lines)"""
TABLES["shown"] = """SELECT doc_id, any_m = 0 AS is_preview,
    CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS kept, CAST(n_lines AS INTEGER) AS n_lines,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INTEGER) AS pos,
    CAST(CASE WHEN any_m = 0 OR inside = 1 THEN no ELSE -1 END AS INTEGER) AS line_no,
    CASE WHEN any_m = 0 OR inside = 1 THEN line ELSE '' END AS line
  FROM picked WHERE any_m = 0 OR inside = 1 OR (inside = 0 AND ahead = 1 AND before = 1)"""

_LIMIT = "pos < CASE WHEN is_preview THEN 10 ELSE 50 END"
_EXCESS = "greatest(kept - CASE WHEN is_preview THEN 10 ELSE 50 END, 0)"


def _with(names: str, body: str, **extra: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS ({extra.get(n, TABLES.get(n))})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({sql})" for n, sql in extra.items() if n not in order]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _ids(where: str) -> str:
    return _with("docs", f"SELECT doc_type, doc_id FROM docs WHERE {where}")


def _found(where: str) -> str:
    return _with("toks", f"SELECT doc_id FROM toks WHERE {where}")


def _has(list_: str, *terms: str) -> str:
    return " AND ".join(f"list_contains({list_}, '{t}')" for t in terms)


def _any_token(list_: str, test: str) -> str:
    return f"len(list_filter({list_}, lambda t: {test})) > 0"


def _close(word: str, k: int) -> str:
    def swapped(w: str) -> list[str]:
        return [w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1) if w[i] != w[i + 1]]

    tests = [f"levenshtein(term, '{word}') <= {k}"]
    tests += [f"1 + levenshtein(term, '{w}') <= {k}" for w in swapped(word)]
    if k == 2:
        twice = sorted({w for o in swapped(word) for w in swapped(o)})
        tests.append("term IN (" + ", ".join(f"'{w}'" for w in twice) + ")")
    return _with("words", "SELECT DISTINCT doc_id FROM words WHERE field = 'contents' AND (" + " OR ".join(tests) + ")")


def _near(run: list[str], slop: int) -> str:
    """Every choice of distinct positions, by self-joins."""
    joins = [f"(SELECT doc_id, pos FROM words WHERE field = 'contents' AND term = '{t}') w{i}" for i, t in enumerate(run)]
    sql = joins[0]
    for i in range(1, len(run)):
        # A tight bound on the distance to slot 0 follows from the slop and keeps the join small.
        near = f"w{i}.doc_id = w0.doc_id AND abs((w{i}.pos - {i}) - w0.pos) <= {slop}"
        distinct = "".join(f" AND w{i}.pos <> w{j}.pos" for j in range(i))
        sql += f" JOIN {joins[i]} ON {near}{distinct}"
    at = ", ".join(f"w{i}.pos - {i}" for i in range(len(run)))
    return _with("words", f"SELECT DISTINCT w0.doc_id FROM {sql} WHERE greatest({at}) - least({at}) <= {slop}")


def _weight(list_: str, term: str, df: str, boost: str = "1") -> str:
    tf = f"len(list_filter({list_}, lambda t: t = '{term}'))"
    idf = f"(1 + ln(n / ({df} + 1)))"
    return f"({boost} * sqrt({tf}) * {idf} * {idf} / sqrt(greatest(len({list_}), 1)))"


def _stat(**counts: str) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE {test}) AS {name}" for name, test in counts.items())
    return f"SELECT CAST(count(*) AS DOUBLE) AS n, {cols} FROM toks"


_THE_EN = _stat(
    c_the=_has("c", "the"), c_en=_has("c", "en"), p_the=_has("p", "the"), p_en=_has("p", "en"))
_THE_EN_SCORE = "round(" + " + ".join(
    f"greatest({_weight('p', t, f'p_{t}', '5')}, {_weight('c', t, f'c_{t}')})" for t in ("the", "en")) + ", 6)"
_THE_EN_WHERE = " AND ".join(f"({_has('c', t)} OR {_has('p', t)})" for t in ("the", "en"))

_EXT_STATS = """SELECT count({c}) AS count, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS avg,
  CAST(sum({c}) AS BIGINT) AS sum, sum(CAST({c} AS DOUBLE) * {c}) AS sum_of_squares,
  round(var_pop({c}), 4) AS variance, round(stddev_pop({c}), 4) AS std_deviation FROM docs"""

_P = [1, 5, 25, 50, 75, 95, 99]


def _percentiles(c: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS percentile, round(quantile_cont(CAST({c} AS DOUBLE), {p / 100}), 4) AS value FROM docs"
        for p in _P)
    return _with("docs", rows)


def _top(c: str) -> str:
    return (f"SELECT {c} AS key, count(*) AS count FROM docs WHERE {c} IS NOT NULL GROUP BY 1 "
            "ORDER BY count DESC, key LIMIT 25")


def _statistics() -> str:
    matches = """SELECT * FROM docs WHERE (doc_type = 'file' AND (list_contains(%s, 'the') OR list_contains(%s, 'the')
        OR list_contains(%s, 'click') OR list_contains(%s, 'click')))
      OR (doc_type = 'commit' AND (list_contains(%s, 'click') OR list_contains(%s, 'click') OR list_contains(%s, 'the')
        OR list_contains(%s, 'the')))""" % (
        _tokens("contents", CODE), _tokens("path", PATH), _tokens("contents", CODE), _tokens("path", PATH),
        _tokens("subject", MESSAGE), _tokens("body", MESSAGE), _tokens("subject", MESSAGE), _tokens("body", MESSAGE))
    blocks = []
    for col, name, total in (("authoremail", "author", "commit"), ("extension", "extension", "file")):
        per = f"SELECT {col} AS key, count(*) AS k FROM m WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY k DESC, key LIMIT 25"
        blocks.append(f"SELECT '{name}Cardinality' AS section, 'value' AS key, CAST(count(DISTINCT {col}) AS DOUBLE) AS value FROM m")
        blocks.append(f"SELECT '{name}Ranking', key, CAST(k AS DOUBLE) FROM ({per})")
        blocks.append(f"""SELECT '{name}Ranking', 'Other', CAST(t - s AS DOUBLE) FROM (
          SELECT (SELECT count(*) FROM m WHERE doc_type = '{total}') AS t, (SELECT sum(k) FROM ({per})) AS s) WHERE t > s""")
    for col in ("charcount", "linecount"):
        for key, e in (("count", f"count({col})"), ("sum", f"sum({col})"), ("min", f"min({col})"), ("max", f"max({col})"),
                       ("average", f"round(avg({col}), 6)"),
                       *[(f"p{p}", f"round(quantile_cont(CAST({col} AS DOUBLE), {p / 100}), 6)") for p in _P]):
            blocks.append(f"SELECT '{col}', '{key}', CAST({e} AS DOUBLE) FROM m")
    for t in ("commit", "file"):
        blocks.append(f"SELECT '{t}count', 'value', CAST(count(*) AS DOUBLE) FROM m WHERE doc_type = '{t}'")
    return _with("docs", "\nUNION ALL ".join(blocks), m=matches)


def _shape(frm: str) -> str:
    """Documents of a tree: one per (blob, path) with its refs."""
    return f"""SELECT project || '^' || repository || '^' || blob || '^:/' || path AS doc_id,
      list_aggregate(list_sort(list(DISTINCT ref)), 'string_agg', ',') AS refs,
      lower(regexp_extract(path, '\\.([^./\\\\]*)$', 1)) AS extension,
      {_charcount('any_value(contents)')} AS charcount, {_linecount('any_value(contents)')} AS linecount, blob AS digest
      FROM {frm} WHERE strlen(contents) <= 262144 GROUP BY project, repository, blob, path"""


def _join(c: str) -> str:
    return f"list_aggregate(list_sort({c}), 'string_agg', ',')"


_COMMIT_HIT = """doc_id, project, repository, %s AS refs, hash, subject, body,
  coalesce(strftime(commitdate, '%%Y-%%m-%%d %%H:%%M'), '') AS commitdate, authorname, authoremail""" % _join("refs")
_SELECTED = """SELECT DISTINCT project, repository, ref FROM newtree SEMI JOIN repos USING (project, repository)
  WHERE ref IN ('refs/heads/master', 'refs/heads/develop')"""

_PAGE_WHERE = (
    "WHERE " + " AND ".join(f"({_has('c', t)} OR {_has('p', t)})" for t in ("this", "the"))
    + """ AND extension IN ('py', 'java')
      AND (project, repository) IN (SELECT (project, repository) FROM grants WHERE user_id = '1')""")
_PAGE_STAT = _stat(c_this=_has("c", "this"), c_the=_has("c", "the"), p_this=_has("p", "this"), p_the=_has("p", "the"))
_PAGE_SCORE = "round(" + " + ".join(
    f"greatest({_weight('p', t, f'p_{t}', '5')}, {_weight('c', t, f'c_{t}')})" for t in ("this", "the")) + ", 6)"

_AUTHOR_NAME, _AUTHOR_MAIL = _tokens("authorname", CODE), _tokens("authoremail", CODE)


def _author(*words: str) -> str:
    return f"(({_has(_AUTHOR_NAME, *words)}) OR ({_has(_AUTHOR_MAIL, *words)}))"


_SNIPPET_TEXT = f"""SELECT doc_id, string_agg(line || chr(10), '' ORDER BY pos) AS source_lines,
    string_agg(lpad(CASE WHEN line_no = -1 THEN '' ELSE CAST(line_no AS VARCHAR) END, w, ' ') || chr(10), '' ORDER BY pos)
      AS source_line_nums,
    any_value(is_preview) AS is_preview, CAST(count(*) AS INTEGER) AS shown_lines,
    any_value({_EXCESS}) AS excess_lines
  FROM (SELECT *, CAST(max(CASE WHEN line_no = -1 THEN 0 ELSE length(CAST(line_no AS VARCHAR)) END)
      OVER (PARTITION BY doc_id) AS INTEGER) AS w FROM shown WHERE {_LIMIT}) GROUP BY doc_id"""

_HASH7 = "902ba3cda1883801594b6e1b452790cc53948fda"
_TALK_S, _TALK_B = _tokens("subject", MESSAGE), _tokens("body", MESSAGE)


def _run(list_: str, *terms: str) -> str:
    joined = "|".join(terms)
    return f"contains('|' || array_to_string({list_}, '|') || '|', '|{joined}|')"


_DELTA = _with("oldtree newtree", """SELECT project, repository, ref, path, o.blob AS old_blob, w.blob AS new_blob,
  CASE WHEN o.blob IS NULL THEN 'A' WHEN w.blob IS NULL THEN 'D' ELSE 'M' END AS status
  FROM oldtree o FULL JOIN newtree w USING (project, repository, ref, path) WHERE o.blob IS DISTINCT FROM w.blob""")

_SELECTED_OLD = _SELECTED.replace("newtree", "oldtree")

# Refs whose last change in one of two batches of events is a deletion.
_DELETED_REFS = """SELECT project, repository, ref FROM refevents GROUP BY project, repository, ref, ts < TIMESTAMP '2024-01-20'
  HAVING arg_max(change_type, (ts, event_id)) = 'DELETE'"""

_LATEST = """SELECT project, repository, ref, arg_max(change_type, (ts, event_id)) AS change_type, count(*) AS events
  FROM refevents GROUP BY project, repository, ref"""

ORACLE: dict[str, str] = {
    # scans and sources
    "repo_catalog": _with("repos", "SELECT * FROM repos"),
    "branch_catalog": _with("branches", "SELECT * FROM branches"),
    "ref_tips": _with("branches", "SELECT project || '^' || repository || '^' || ref AS ref_key, tip FROM branches"),
    "tree_delta": _DELTA,
    "size_prune": _with("blobs", "SELECT blob, CAST(strlen(contents) AS INTEGER) AS size FROM blobs WHERE strlen(contents) <= 4096"),
    "blob_contents": _with("blobs", f"""SELECT blob, blob AS digest, {_charcount('contents')} AS charcount,
      {_linecount('contents')} AS linecount FROM blobs WHERE strlen(contents) <= 262144"""),
    "text_only": """SELECT doc_id, kind, NOT regexp_matches(h, '^(..)*(0[0-8]|0[ef]|1[0-9a-f]|7f)') AS is_text FROM (
      SELECT doc_id, 'text' AS kind, lower(hex(encode(text))) AS h FROM documents
      UNION ALL SELECT doc_id, 'digest', sha256(text) FROM documents)""",
    "commits_added": _with("oldreach newreach", "SELECT * FROM newreach EXCEPT SELECT * FROM oldreach"),
    "commits_removed": _with("oldreach newreach", "SELECT * FROM oldreach EXCEPT SELECT * FROM newreach"),
    "commit_shape": _with("commits", """SELECT project, repository, hash,
      strftime(commitdate, '%Y-%m-%d %H:%M') AS commitdate, authorname, authoremail, subject,
      CASE WHEN subject = 'signup' THEN '' ELSE body END AS body FROM commits"""),
    "commit_dates": _with("commits", "SELECT hash, CAST(floor(epoch(commitdate)) AS BIGINT) AS epoch FROM commits"),
    "checkpoint_lag": _with("branches", f"""SELECT project, repository, ref, tip, CASE WHEN ref = 'refs/heads/master'
      THEN sha1(tip) ELSE '4b825dc642cb6eb9a060e54bf8d69288fbee4904' END AS last FROM branches
      WHERE ref <> 'refs/heads/develop'"""),
    "search_scan": _with("docs", "SELECT doc_type, project, count(*) AS n FROM docs GROUP BY ALL"),
    # derived columns
    "extension": _with("allfiles", "SELECT path, extension FROM allfiles"),
    "charcount": _with("files", "SELECT doc_id, charcount FROM files"),
    "linecount": _with("allfiles", "SELECT doc_id, linecount FROM allfiles"),
    "doc_keys": _with("docs", "SELECT doc_type, doc_id, project || '^' || repository AS repo_key FROM docs"),
    "hit_refs": _with("docs", f"SELECT doc_id, {_join('refs')} AS refs FROM docs"),
    "primary_ref": _with("files", """SELECT doc_id, CASE WHEN list_contains(refs, 'refs/heads/master')
      THEN 'refs/heads/master' ELSE list_min(refs) END AS primary_ref FROM files"""),
    "commit_hits": _with("commits talk", f"SELECT {_COMMIT_HIT} FROM (SELECT * FROM commits UNION ALL SELECT * FROM talk)"),
    "file_hits": _with("files", f"""SELECT doc_id, project, repository, {_join('refs')} AS refs, path, blob,
      CASE WHEN list_contains(refs, 'refs/heads/master') THEN 'refs/heads/master' ELSE list_min(refs) END AS primary_ref,
      extension, extension IN ('txt', 'log') AS no_highlight, charcount, linecount FROM files"""),
    "no_highlight": _with("files", "SELECT doc_id, extension IN ('txt', 'log') AS no_highlight FROM files"),
    "hit_names": _with("docs repos", """SELECT doc_id, projectname, repositoryname FROM docs
      JOIN repos USING (project, repository)"""),
    "union_types": _with("docs", """SELECT doc_type, doc_id, path, extension, subject, authoremail, linecount FROM docs"""),
    # tokenizers
    "tok_code": _with("files", f"SELECT unnest({_tokens('contents', CODE)}) AS term, count(*) AS n FROM files GROUP BY 1"),
    "tok_author": _with("commits", f"""SELECT unnest(list_concat({_AUTHOR_NAME}, {_AUTHOR_MAIL})) AS term, count(*) AS n
      FROM commits GROUP BY 1"""),
    "tok_ref": _with("docs", f"""SELECT unnest({_tokens("ref", "/")}) AS term, count(*) AS n
      FROM (SELECT unnest(refs) AS ref FROM docs) GROUP BY 1"""),
    "tok_path": _with("allfiles", f"SELECT unnest({_tokens('path', PATH)}) AS term, count(*) AS n FROM allfiles GROUP BY 1"),
    "tok_message": _with("commits talk", f"""SELECT unnest(list_concat({_TALK_S}, {_TALK_B})) AS term, count(*) AS n
      FROM (SELECT subject, body FROM commits UNION ALL SELECT subject, body FROM talk) GROUP BY 1"""),
    "tok_exact": _with("files", "SELECT extension AS term, count(*) AS n FROM files WHERE extension <> '' GROUP BY 1"),
    # filters
    "filter_type": _ids("doc_type = 'commit'"),
    "filter_type_default": _ids("doc_type IN ('file', 'commit')"),
    "filter_project": _ids("project IN ('en', 'es', 'EN')"),
    "filter_repository": _ids("repository IN ('src1', 'src17')"),
    "filter_project_repository": _ids("project = 'en' AND repository = 'src3'"),
    "filter_ref_exact": _ids("list_contains(refs, 'refs/heads/feature/a')"),
    "filter_ref_tokens": _ids("""list_contains(refs, 'refs/heads/feature/b')
      OR (list_contains(refs, 'refs/heads/master') AND list_contains(refs, 'refs/heads/feature/a'))"""),
    "filter_extension": _ids("doc_type = 'commit' OR extension IN ('java', 'sql')"),
    "filter_author": _ids(f"""doc_type = 'file' OR {_author('user', '7')} OR {_author('user12', 'com')}
      OR {_author('user', 'user12')}"""),
    "filter_date": _ids("""doc_type = 'file' OR (commitdate >= TIMESTAMP '2024-01-05'
      AND commitdate < TIMESTAMP '2024-01-12')"""),
    "filter_date_open": _ids("doc_type = 'file' OR commitdate < TIMESTAMP '2024-01-12'"),
    "acl_search": _with("docs grants", """SELECT doc_type, doc_id FROM docs
      SEMI JOIN (SELECT * FROM grants WHERE user_id = '3') USING (project, repository)"""),
    "acl_administrator": _ids("true"),
    "acl_no_grants": _ids("false"),
    "readable_repos": _with("repos grants", """SELECT project, repository, projectname FROM repos
      SEMI JOIN (SELECT * FROM grants WHERE user_id = '2') USING (project, repository)"""),
    "valid_hits": _with("allfiles repos", "SELECT doc_id FROM allfiles SEMI JOIN repos USING (project, repository) WHERE len(refs) > 0"),
    "refs_to_index": _with("branches", """SELECT project, repository, ref FROM branches WHERE
      (project IN ('en', 'de') AND ref IN ('refs/heads/master', 'refs/heads/develop'))
      OR (project = 'fr' AND (ref = 'refs/heads/master' OR regexp_full_match(ref, 'refs/heads/feature/.')))"""),
    # text match
    "match_all_terms": _found(" AND ".join(f"({_has('c', t)} OR {_has('p', t)})" for t in ("the", "en", "java"))),
    "match_boolean": _found(f"""({_has('c', 'the')} OR {_has('p', 'the')}) AND ({_has('c', 'ing')} OR {_has('p', 'ing')}
      OR {_has('c', 'tion')} OR {_has('p', 'tion')}) AND NOT {_has('p', 'md')}"""),
    "match_wildcard": _found(_any_token("list_concat(c, p)", "regexp_full_match(t, 't.e.*ing')")),
    "match_fuzzy": _close("there", 1),
    "match_fuzzy_two": _close("nation", 2),
    "match_phrase": _with("words", """SELECT DISTINCT a.doc_id FROM words a JOIN words b
      ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'the' AND b.term = 'of'"""),
    "match_phrase_path": _with("words", """SELECT DISTINCT a.doc_id FROM words a JOIN words b
      ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND a.field = 'path' AND b.field = 'path'
      WHERE a.term = 'en' AND b.term = 'src3'"""),
    "match_sloppy": _near(["the", "of", "and"], 4),
    "match_sloppy_repeat": _near(["the", "of", "the"], 3),
    "match_hash": _with("commits", f"SELECT doc_id, hash FROM commits WHERE hash = '{_HASH7}' OR starts_with(hash, 'b1d57811')"),
    "match_message": _with("talk", f"""SELECT doc_id FROM talk WHERE
      ((({_has(_TALK_S, 'été', 'les')}) OR ({_has(_TALK_B, 'été', 'les')})) AND NOT {_run(_TALK_B, 'de', 'la')})
      OR {_run(_TALK_S, 'les', 'eau')} OR {_run(_TALK_B, 'les', 'eau')}"""),
    "match_prefix": _found(_any_token("c", "starts_with(t, 'thi')")),
    "match_regex": _found(_any_token("c", "regexp_full_match(t, 'er[aeiou]+[a-z]{0,2}tion')")),
    "match_range": _found(_any_token("c", "t >= 'zu' AND t <= 'zz'")),
    "match_lenient": _found("charcount BETWEEN 1000 AND 2000"),
    "match_fields": _found(_has("p", "java")),
    "browse_all": _with("docs", "SELECT doc_type, doc_id, CAST(1 AS DOUBLE) AS score FROM docs"),
    "match_none": _with("files", "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS hits FROM files"),
    "search_numbers": _with("files", "SELECT 'file' AS doc_type, doc_id FROM files WHERE charcount BETWEEN 1000 AND 2000"),
    "rank_tfidf": _with("toks", f"SELECT doc_id, round({_weight('c', 'the', 'd')}, 6) AS score FROM toks, s WHERE {_has('c', 'the')}",
                        s=_stat(d=_has("c", "the"))),
    "rank_boosted": _with("toks", f"SELECT doc_id, {_THE_EN_SCORE} AS score FROM toks, s WHERE {_THE_EN_WHERE}", s=_THE_EN),
    "rank_any": _with("toks", f"""SELECT doc_id, round((greatest({_weight('p', 'ing', 'p_ing', '5')}, {_weight('c', 'ing', 'c_ing')})
        + greatest(2 * {_weight('p', 'sql', 'p_sql', '5')}, 2 * {_weight('c', 'sql', 'c_sql')})
        + CASE WHEN zp THEN 5 WHEN zc THEN 1 ELSE 0 END)
        * (CAST({_has('c', 'ing')} OR {_has('p', 'ing')} AS INT) + CAST({_has('c', 'sql')} OR {_has('p', 'sql')} AS INT)
          + CAST(zc OR zp AS INT)) / 3.0, 6) AS score
      FROM (SELECT *, {_any_token('c', "starts_with(t, 'zen')")} AS zc, {_any_token('p', "starts_with(t, 'zen')")} AS zp FROM toks), s
      WHERE {_has('c', 'ing')} OR {_has('p', 'ing')} OR {_has('c', 'sql')} OR {_has('p', 'sql')} OR zc OR zp""",
                      s=_stat(c_ing=_has("c", "ing"), p_ing=_has("p", "ing"), c_sql=_has("c", "sql"), p_sql=_has("p", "sql"))),
    "rank_phrase": _with("words", """SELECT doc_id, round(sqrt(k) * pow(2 + ln(n / (d_the + 1)) + ln(n / (d_of + 1)), 2) / sqrt(len(c)), 6) AS score
      FROM (SELECT a.doc_id, count(*) AS k FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
        AND a.field = 'contents' AND b.field = 'contents' WHERE a.term = 'the' AND b.term = 'of' GROUP BY 1)
      JOIN toks USING (doc_id), s""", s=_stat(d_the=_has("c", "the"), d_of=_has("c", "of"))),
    # token tables
    "vocabulary": _with("words", "SELECT field, term, count(DISTINCT doc_id) AS df FROM words GROUP BY ALL"),
    "field_lengths": _with("toks", """SELECT doc_id, 'contents' AS field, CAST(len(c) AS INTEGER) AS length FROM toks
      UNION ALL SELECT doc_id, 'path', CAST(len(p) AS INTEGER) FROM toks"""),
    "term_lookup": _with("words", "SELECT field, term, doc_id, CAST(pos AS INTEGER) AS pos FROM words WHERE term IN ('ing', 'java', 'tion')"),
    "index_all_terms": _found(" AND ".join(f"({_has('c', t)} OR {_has('p', t)})" for t in ("the", "en", "java"))),
    "index_phrase": _with("toks", """SELECT doc_id, 'contents' AS field, CAST(i - 1 AS INTEGER) AS start FROM (
      SELECT doc_id, c, unnest(range(1, len(c))) AS i FROM toks) WHERE c[i] = 'the' AND c[i + 1] = 'of'"""),
    "index_many_terms": _found(_has("c", *MANY_WORDS)),
    "index_wildcard": _found(_any_token("c", "regexp_full_match(t, 't.e.*ing')")),
    # statistics
    "author_cardinality": _with("docs", "SELECT count(DISTINCT authoremail) AS cardinality FROM docs"),
    "approximate_cardinality": _with("docs", "SELECT count(DISTINCT authoremail) AS cardinality, true AS near FROM docs"),
    "approximate_percentiles": """SELECT CAST(unnest([1, 5, 25, 50, 75, 95, 99]) AS DOUBLE) AS percentile, true AS near""",
    "merged_author_cardinality": _with("docs", "SELECT count(DISTINCT authoremail) AS cardinality, true AS near FROM docs"),
    "merged_extension_cardinality": _with("docs", "SELECT count(DISTINCT extension) AS cardinality, true AS near FROM docs"),
    "merged_hash_cardinality": _with("commits", "SELECT count(DISTINCT hash) AS cardinality, true AS near FROM commits"),
    "extension_cardinality": _with("docs", "SELECT count(DISTINCT extension) AS cardinality FROM docs"),
    "author_ranking": _with("docs", _top("authoremail")),
    "extension_ranking": _with("docs", _top("extension")),
    "ranking_with_other": _with("docs", f"""SELECT key, count, false AS other, round(count / total, 9) AS proportion
      FROM t, (SELECT CAST(count(authoremail) AS DOUBLE) AS total FROM docs)
      UNION ALL SELECT 'Other', CAST(total - shown AS BIGINT), true, round((total - shown) / total, 9)
      FROM (SELECT CAST(count(authoremail) AS DOUBLE) AS total FROM docs), (SELECT sum(count) AS shown FROM t) WHERE total > shown""",
                                t=_top("authoremail")),
    "charcount_percentiles": _percentiles("charcount"),
    "linecount_percentiles": _percentiles("linecount"),
    "charcount_stats": _with("docs", _EXT_STATS.format(c="charcount")),
    "linecount_stats": _with("docs", _EXT_STATS.format(c="linecount")),
    "type_counts": _with("docs", """SELECT count(*) FILTER (doc_type = 'commit') AS commitcount,
      count(*) FILTER (doc_type = 'file') AS filecount FROM docs"""),
    "search_statistics": _statistics(),
    "total_hits": _with("toks commits grants", f"""SELECT CAST(
        (SELECT count(*) FROM toks WHERE ({_has('c', 'the')} OR {_has('p', 'the')}) AND project IN ('en', 'de')
          AND (project, repository) IN (SELECT (project, repository) FROM grants WHERE user_id = '1'))
      + (SELECT count(*) FROM commits WHERE ({_has(_TALK_S, 'the')} OR {_has(_TALK_B, 'the')}) AND project IN ('en', 'de')
          AND (project, repository) IN (SELECT (project, repository) FROM grants WHERE user_id = '1')) AS BIGINT) AS total_hits"""),
    # pages
    "top_page": _with("toks", f"""SELECT 'file' AS doc_type, doc_id, project, repository, {_THE_EN_SCORE} AS score
      FROM toks, s WHERE {_THE_EN_WHERE} ORDER BY score DESC, doc_id LIMIT 50 OFFSET 50""", s=_THE_EN),
    "search_answer": _with("toks", f"""SELECT 'file' AS doc_type, doc_id, project, repository, {_THE_EN_SCORE} AS score,
      upper(project) AS projectname, upper(repository) AS repositoryname, total AS total_hits,
      CAST(ceil(total / 50.0) AS BIGINT) AS pages, least(total, 51) AS result_from, least(total, 100) AS result_to
      FROM toks, s, (SELECT count(*) AS total FROM toks WHERE {_THE_EN_WHERE})
      WHERE {_THE_EN_WHERE} ORDER BY score DESC, doc_id LIMIT 50 OFFSET 50""", s=_THE_EN),
    "next_page": _with("toks", f"""SELECT 'file' AS doc_type, doc_id, project, repository, {_THE_EN_SCORE} AS score
      FROM toks, s WHERE {_THE_EN_WHERE} ORDER BY score DESC, doc_id LIMIT 50 OFFSET 50""", s=_THE_EN),
    "page_bounds": _with("toks", f"""SELECT t AS total_hits, CAST(ceil(t / 50.0) AS BIGINT) AS pages,
      least(t, 101) AS result_from, least(t, 150) AS result_to
      FROM (SELECT count(*) AS t FROM toks WHERE {_has('c', 'the')})"""),
    # snippets
    "split_lines": _with("allfiles", f"""SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no
      FROM (SELECT doc_id, {_LINES} AS l FROM allfiles)"""),
    "highlight_terms": _with("forms", "SELECT doc_id, array_to_string(list_slice(list_distinct_ordered, 1, 50), ',') AS forms FROM forms",
                             forms=_forms("lower(t) IN ('the', 'of')")),
    "match_lines": _with("picked", "SELECT doc_id, CAST(no - 1 AS INTEGER) AS line_no FROM picked WHERE m = 1"),
    "preview_lines": _with("shown", f"SELECT doc_id, is_preview, {_EXCESS} AS excess, pos, line_no, line FROM shown WHERE {_LIMIT}",
                           forms="SELECT doc_id, contents, []::VARCHAR[] AS list_distinct_ordered FROM files"),
    "snippet": _with("shown", f"SELECT doc_id, is_preview, {_EXCESS} AS excess, pos, line_no, line FROM shown WHERE {_LIMIT}"),
    "snippet_text": _with("shown", _SNIPPET_TEXT),
    "search_with_snippets": _with("shown toks grants", f"""SELECT doc_id,
        CASE WHEN list_contains(refs, 'refs/heads/master') THEN 'refs/heads/master' ELSE list_min(refs) END AS primary_ref,
        extension, extension IN ('txt', 'log') AS no_highlight, score, source_lines, source_line_nums, is_preview,
        shown_lines, excess_lines
      FROM (SELECT doc_id, refs, extension, {_PAGE_SCORE} AS score FROM toks, st {_PAGE_WHERE}
        ORDER BY score DESC, doc_id LIMIT 50) JOIN ({_SNIPPET_TEXT}) USING (doc_id)""",
                                  forms=_forms("lower(t) IN ('this', 'the')"), st=_PAGE_STAT),
    "search_commit_hits": _with("commits", f"""SELECT {_COMMIT_HIT}, score FROM (
      SELECT *, greatest(4 * sqrt(len(list_filter({_TALK_S}, lambda t: t = 'purchase'))) * pow(1 + ln(n / (ds + 1)), 2) / sqrt(len({_TALK_S})),
        CASE WHEN {_has(_TALK_B, 'purchase')} THEN 2 * sqrt(len(list_filter({_TALK_B}, lambda t: t = 'purchase')))
          * pow(1 + ln(n / (db + 1)), 2) / sqrt(len({_TALK_B})) ELSE 0 END) AS raw, round(raw, 6) AS score
      FROM commits, (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE {_has(_TALK_S, 'purchase')}) AS ds,
        count(*) FILTER (WHERE {_has(_TALK_B, 'purchase')}) AS db FROM commits)
      WHERE ({_has(_TALK_S, 'purchase')} OR {_has(_TALK_B, 'purchase')})
        AND ({_author('user', '7')} OR {_author('user12')}) AND commitdate >= TIMESTAMP '2024-01-03'
      ORDER BY score DESC, doc_id LIMIT 50)"""),
    # maintenance
    "add_ref": _with("files", f"""SELECT doc_id, {_join("r")} AS refs FROM (SELECT doc_id,
      CASE WHEN extension = 'py' THEN list_distinct(list_append(refs, 'refs/heads/develop')) ELSE refs END AS r FROM files)"""),
    "remove_ref": _with("files", """SELECT doc_id, array_to_string(r, ',') AS refs FROM (
      SELECT doc_id, list_filter(refs, lambda x: x <> 'refs/heads/feature/b') AS r FROM files) WHERE len(r) > 0"""),
    "docs_to_insert": _with("oldtree newtree files", f"""SELECT doc_id, {_join('list(DISTINCT ref)')} AS add_refs FROM (
      SELECT project || '^' || repository || '^' || blob || '^:/' || path AS doc_id, ref FROM (
        SELECT project, repository, ref, path, blob FROM newtree
        EXCEPT SELECT project, repository, ref, path, blob FROM oldtree))
      WHERE doc_id NOT IN (SELECT doc_id FROM files) GROUP BY doc_id"""),
    "apply_delta": _with("newtree", _shape("newtree")),
    "apply_commit_delta": _with("newreach commits", f"""SELECT doc_id, {_join('list(DISTINCT ref)')} AS refs,
      any_value(authoremail) AS authoremail, any_value(subject) AS subject,
      any_value(CASE WHEN subject = 'signup' THEN '' ELSE body END) AS body
      FROM newreach n JOIN commits c USING (project, repository, hash) GROUP BY doc_id"""),
    "reindex_ref": _with("oldtree newtree", _shape("""(SELECT * FROM oldtree
      WHERE NOT (project = 'es' AND repository = 'src4' AND ref = 'refs/heads/master')
      UNION ALL SELECT * FROM newtree WHERE project = 'es' AND repository = 'src4' AND ref = 'refs/heads/master')""")),
    "repo_purge": _ids("NOT (project = 'en' AND repository = 'src5')"),
    "full_build": _with("newtree repos", _shape(f"(SELECT * FROM newtree SEMI JOIN ({_SELECTED}) USING (project, repository, ref))")),
    "full_build_commits": _with("newtree repos newreach commits", f"""SELECT doc_id, project, repository, {_join('list(DISTINCT ref)')} AS refs, hash,
      any_value(subject) AS subject, any_value(CASE WHEN subject = 'signup' THEN '' ELSE body END) AS body,
      strftime(any_value(commitdate), '%Y-%m-%d %H:%M') AS commitdate, any_value(authorname) AS authorname,
      any_value(authoremail) AS authoremail
      FROM newreach SEMI JOIN ({_SELECTED}) USING (project, repository, ref) JOIN commits USING (project, repository, hash)
      GROUP BY doc_id, project, repository, hash"""),
    "store_update": _with("newtree repos", _shape(f"(SELECT * FROM newtree SEMI JOIN ({_SELECTED}) USING (project, repository, ref))")),
    "store_purge": _with("newtree repos", _shape(f"""(SELECT * FROM newtree SEMI JOIN ({_SELECTED}) USING (project, repository, ref)
      WHERE NOT (project = 'en' AND repository = 'src5'))""")),
    "store_reindex_repository": _with("newtree repos", _shape(f"(SELECT * FROM newtree SEMI JOIN ({_SELECTED}) USING (project, repository, ref))")),
    "store_checkpoints": _with("newtree repos", f"""SELECT DISTINCT project, repository, ref,
      sha1(project || '^' || repository || '^' || ref) AS hash FROM newtree SEMI JOIN ({_SELECTED}) USING (project, repository, ref)"""),
    # events
    "stream_coalesce": _with("refevents", _LATEST),
    "stream_pending": _with("refevents", _LATEST),
    "stream_pending_restart": _with("refevents", _LATEST),
    "stream_store": _with("oldtree newtree repos refevents", _shape(f"""(
      SELECT * FROM newtree SEMI JOIN ({_SELECTED}) USING (project, repository, ref) SEMI JOIN refevents USING (project, repository, ref)
      UNION ALL SELECT * FROM oldtree SEMI JOIN ({_SELECTED_OLD}) USING (project, repository, ref)
      ANTI JOIN ({_DELETED_REFS} UNION SELECT project, repository, ref FROM refevents SEMI JOIN ({_SELECTED}) USING (project, repository, ref))
      USING (project, repository, ref))""")),
    "index_gate": _with("oldtree repos", _shape(f"(SELECT * FROM oldtree SEMI JOIN ({_SELECTED_OLD}) USING (project, repository, ref))")),
    "stream_route": _with("refevents branches", f"""SELECT project, repository, ref,
      CASE WHEN change_type = 'DELETE' THEN 'reindex' ELSE 'update' END AS action FROM ({_LATEST})
      LEFT JOIN (SELECT project, repository, ref, true AS known FROM branches) USING (project, repository, ref)
      WHERE change_type = 'DELETE' OR known"""),
}

ORACLE |= {f"stored_match_{name}": ORACLE[f"match_{name}"] for name in (
    "all_terms boolean wildcard fuzzy fuzzy_two phrase phrase_path sloppy sloppy_repeat prefix regex range hash message").split()}
ORACLE |= {f"stored_{name}": ORACLE[name] for name in ("rank_tfidf", "rank_boosted", "rank_any", "rank_phrase", "top_page")}

# The same over the documents of the new tips.
_NEW_FILES = f"""SELECT {_FILE_COLUMNS} FROM (SELECT project, repository, blob, path, list(ref) AS refs, any_value(contents) AS contents
  FROM newtree SEMI JOIN ({_SELECTED}) USING (project, repository, ref)
  WHERE strlen(contents) <= 262144 GROUP BY project, repository, blob, path)"""
ORACLE["stored_update_rank"] = _with(
    "newtree repos toks", f"SELECT doc_id, {_THE_EN_SCORE} AS score FROM toks, s WHERE {_THE_EN_WHERE}", files=_NEW_FILES, s=_THE_EN)
ORACLE["stored_update_vocabulary"] = _with(
    "newtree repos words", "SELECT field, term, count(DISTINCT doc_id) AS df FROM words GROUP BY ALL", files=_NEW_FILES)
