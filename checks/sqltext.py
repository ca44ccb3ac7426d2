"""Building blocks of the comparison SQL: regular expressions as RE2 reads them, and CTE chains."""

from __future__ import annotations

from checks.views import AS_OF, view_sql
from tomewright import constants as K
from tomewright.functions.regex import EOL, WS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str, flags: str = "") -> str:
    r"""RE2 has ASCII ``\b`` as ECMAScript does, but its own idea of space and lines."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        t = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
        if t == r"\s":
            out.append(WS if in_class else f"[{WS}]")
        elif t == "." and not in_class:
            out.append(f"[^{EOL}]")
        else:
            in_class = t == "[" or (in_class and t != "]")
            out.append(t)
        i += len(t)
    return ("(?i)" if "i" in flags else "") + "".join(out)


def re2_lines(pattern: str, flags: str = "") -> str:
    """For patterns bound to a line start: the line end in front becomes group 1."""
    if "m" not in flags:
        return re2(pattern, flags)
    return f"(^|[{EOL}])" + re2(pattern.removeprefix("^").removesuffix("$"), flags)


def secret_steps() -> list[tuple[str, str, str]]:
    """(name, pattern, replacement) as RE2 reads them.

    RE2 cannot look behind, so the one pattern that starts at a line start takes the line end in
    front of it into the match and puts it back.
    """
    steps = []
    for name, pattern, flags, replacement in K.SECRET_PATTERNS:
        repl = replacement.replace("$", "\\")
        if "m" in flags:
            body = re2(pattern.removeprefix("^").removesuffix("$"))
            steps.append((name, f"(?i)(^|[{EOL}]){body}", "\\1\\2=[REDACTED]"))
        else:
            steps.append((name, re2(pattern, flags), repl))
    return steps


def redacted(source: str, out: str, *, extras: bool = False) -> str:
    """CTEs that end in ``out``: the rows of ``source`` with ``content`` redacted."""
    steps = secret_steps()
    ctes = [f"{out}_0 AS (SELECT *, content AS c0 FROM {source})"]
    for n, (_, pattern, repl) in enumerate(steps, 1):
        ctes.append(f"{out}_{n} AS (SELECT *, regexp_replace(c{n - 1}, {lit(pattern)}, "
                    f"{lit(repl)}, 'g') AS c{n} FROM {out}_{n - 1})")
    last = len(steps)
    more = ""
    if extras:
        counts = " + ".join(
            f"CASE WHEN c{n} <> c{n - 1} THEN len(regexp_extract_all(c{n - 1}, {lit(p)})) ELSE 0 END"
            for n, (_, p, _) in enumerate(steps, 1))
        names = " || ".join(
            f"CASE WHEN c{n} <> c{n - 1} THEN {lit(name + ' ')} ELSE '' END"
            for n, (name, _, _) in enumerate(steps, 1))
        more = f", {counts} AS redactions, trim({names}) AS triggered"
    drop = ", ".join(f"c{n}" for n in range(last))
    ctes.append(f"{out} AS (SELECT * EXCLUDE ({drop}, content, c{last}), c{last} AS content{more} "
                f"FROM {out}_{last})")
    return ",\n".join(ctes)


def basename(path: str) -> str:
    return f"split_part({path}, '/', -1)"


def raw_extension(path: str) -> str:
    return f"regexp_extract({basename(path)}, '^.+(\\.[^.]*)$', 1)"


def extension(path: str) -> str:
    return f"lower({raw_extension(path)})"


def dirname(path: str) -> str:
    return f"CASE WHEN contains({path}, '/') THEN regexp_replace({path}, '/[^/]*$', '') ELSE '.' END"


def ignored(path: str) -> str:
    names = ", ".join(lit(p) for p in K.DEFAULT_IGNORE_PATTERNS if not p.startswith("*."))
    ends = [p[1:] for p in K.DEFAULT_IGNORE_PATTERNS if p.startswith("*.")]
    some = " OR ".join(f"ends_with(s, {lit(e)})" for e in ends)
    return (f"(list_has_any(string_split({path}, '/'), [{names}]) OR "
            f"len(list_filter(string_split({path}, '/'), lambda s: {some})) > 0)")


def sensitive(path: str) -> str:
    names = ", ".join(lit(p) for p in K.SENSITIVE_FILENAMES)
    base = basename(path)
    tests = [f"{base} IN ({names})", f"{path} IN ({names})"]
    for p in K.SENSITIVE_NAME_PATTERNS:
        if "(?!" in p:  # no look-ahead in RE2: some ".env." that is not ".env.example"
            tests.append(f"len(list_filter(regexp_extract_all({base}, '(?i)\\.env\\.(?:example)?'), "
                         f"lambda m: NOT ends_with(lower(m), 'example'))) > 0")
        else:
            tests.append(f"regexp_matches({base}, {lit(re2(p, 'i'))})")
    return "(" + " OR ".join(tests) + ")"


def readable(raw: str) -> str:
    """Rows of a raw file view that are read: path, content, size."""
    return (f"SELECT path, content, strlen(content) AS size FROM ({raw}) "
            f"WHERE NOT {ignored('path')} AND NOT {sensitive('path')} "
            f"AND strlen(content) <= {K.MAX_FILE_BYTES}")


def tokens(content: str) -> str:
    astral = f"len(regexp_extract_all({content}, '[\\x{{10000}}-\\x{{10FFFF}}]'))"
    return f"CAST(ceil((length({content}) + {astral}) / 4.0) AS BIGINT)"


def line_count(content: str) -> str:
    return f"CAST(length({content}) - length(replace({content}, chr(10), '')) + 1 AS INT)"


def prepared(source: str, out: str) -> str:
    """CTEs up to ``out``: path, size, content (redacted), lines, tokens, hash, extension."""
    return (redacted(source, f"{out}_red") + f""",
{out} AS (SELECT path, size, content, {line_count('content')} AS lines,
  {tokens('content')} AS tokens, substr(sha256(content), 1, 16) AS hash,
  {extension('path')} AS extension FROM {out}_red)""")


_SPACES = lit("\t\n\x0b\x0c\r " + "".join(
    chr(n) for n in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                     0x3000, 0xFEFF)))


def trim(s: str) -> str:
    return f"trim({s}, {_SPACES})"


def yaml_string(yaml: str, key: str) -> str:
    head, ws = f"(?:^|[{EOL}]){key}:[{WS}]*", f"[{WS}]*(?:$|[{EOL}])"
    strict, loose = lit(f'{head}"([^"]*)"{ws}'), lit(f"{head}([^:\\n]+?){ws}")
    return (f"CASE WHEN regexp_matches({yaml}, {strict}) "
            f"THEN {trim(f'regexp_extract({yaml}, {strict}, 1)')} "
            f"WHEN regexp_matches({yaml}, {loose}) "
            f"THEN {trim(f'regexp_extract({yaml}, {loose}, 1)')} END")


def loaded(source: str, out: str, as_of: str) -> str:
    """CTEs that read ``source(filename, document)`` into ``out``, one row per entry."""
    keys = {"tags": "tags", "related": "related", "source_files": "sourceFiles"}
    lines = ", ".join(
        f"CASE WHEN strpos(yaml, '{k}:') = 0 THEN [] ELSE list_transform(string_split("
        f"substr(yaml, strpos(yaml, '{k}:') + {len(k) + 1}), chr(10)), "
        f"lambda l: {trim('l')}) END AS {c}_l" for c, k in keys.items())
    first = ", ".join(f"list_position(list_transform({c}_l, lambda l: starts_with(l, '- ')), true) "
                      f"AS {c}_a" for c in keys)
    rest = ", ".join(f"CASE WHEN coalesce({c}_a, 0) = 0 THEN [] ELSE {c}_l[{c}_a:] END AS {c}_r"
                     for c in keys)
    stop = ", ".join(f"coalesce(list_position(list_transform({c}_r, "
                     f"lambda l: starts_with(l, '- ')), false), 0) AS {c}_z" for c in keys)
    items = ", ".join(f"list_transform(CASE WHEN {c}_z = 0 THEN {c}_r ELSE {c}_r[:{c}_z - 1] END, "
                      f"lambda l: {trim('substr(l, 3)')}) AS {c}" for c in keys)
    return f"""{out}_1 AS (SELECT filename, document, strpos(substr(document, 4), '---') AS e
  FROM {source} WHERE starts_with(document, '---')),
{out}_2 AS (SELECT filename, {trim('substr(document, 4, e - 1)')} AS yaml,
  {trim('substr(document, e + 6)')} AS content FROM {out}_1 WHERE e > 0),
{out}_3 AS (SELECT *, {lines} FROM {out}_2),
{out}_4 AS (SELECT *, {first} FROM {out}_3),
{out}_5 AS (SELECT *, {rest} FROM {out}_4),
{out}_6 AS (SELECT *, {stop} FROM {out}_5),
{out} AS (SELECT filename, coalesce({yaml_string('yaml', 'title')}, filename) AS title,
  coalesce({yaml_string('yaml', 'description')}, '') AS description,
  coalesce({yaml_string('yaml', 'category')}, 'general') AS category,
  coalesce({yaml_string('yaml', 'updatedAt')}, '{as_of}') AS updated_at,
  {items}, content FROM {out}_6)"""


# Named CTEs: name -> (the CTEs it reads, its text). A text may define helper CTEs as well.
CTES: dict[str, tuple[list[str], str]] = {
    "files_raw": ([], f"files_raw AS ({view_sql('files_raw')})"),
    "files_read": (["files_raw"], "files_read AS (" + readable("SELECT * FROM files_raw") + ")"),
    "files": (["files_read"], prepared("files_read", "files")),
    "all_plans": (["files"], f"""dirs AS (SELECT *, {dirname('path')} AS dir FROM files),
all_plans AS (SELECT *, CASE WHEN flat = '_' THEN 'general.md' ELSE flat || '.md' END AS filename
  FROM (SELECT dir, regexp_replace(regexp_replace(dir, '[:/\\\\]', '_', 'g'), '_+', '_', 'g') AS flat,
    CASE WHEN dir = '.' THEN 'root' ELSE dir END AS title, 'module' AS category,
    'Files in ' || dir AS brief, count(*) AS n_sources, min(path) AS first_path
  FROM dirs GROUP BY dir))"""),
    "plans": (["all_plans"], """plans AS (SELECT * FROM all_plans
  QUALIFY row_number() OVER (PARTITION BY filename ORDER BY first_path DESC) = 1),
sources AS (SELECT filename, path, lines FROM dirs JOIN plans USING (dir))"""),
    "entries": (["plans"], f"""tag_rows AS (
  SELECT filename, category AS tag, '' AS pos FROM plans
  UNION ALL SELECT filename, substr({raw_extension('path')}, 2), path FROM sources
  WHERE {raw_extension('path')} NOT IN ('', '.')),
entry_tags AS (SELECT filename, tag, min(pos) AS pos FROM tag_rows GROUP BY filename, tag),
entry_bodies AS (SELECT p.filename, '## Purpose' || chr(10) || chr(10) || any_value(brief)
  || chr(10) || chr(10) || '## Files (' || any_value(n_sources) || ')' || chr(10) || chr(10)
  || string_agg('- `' || path || '` (' || lines || ' lines)' || chr(10), '' ORDER BY path)
  || chr(10) || '## When to Reference' || chr(10) || chr(10)
  || '> Consult this entry when you need to understand ' || lower(any_value(title)) || '.'
  || chr(10) AS content
  FROM plans p JOIN sources s USING (filename) GROUP BY p.filename),
entries AS (SELECT filename, title, brief AS description, category, n_sources, content
  FROM plans JOIN entry_bodies USING (filename))"""),
    "docs": (["entries"], redacted("entries", "body_redacted") + f""",
headers AS (SELECT filename, '---' || chr(10) || 'title: "' || replace(title, '"', '\"') || '"'
  || chr(10) || 'description: "' || replace(description, '"', '\"') || '"' || chr(10)
  || 'category: ' || category || chr(10) || 'tags:' || chr(10)
  || (SELECT string_agg('  - ' || tag || chr(10), '' ORDER BY pos) FROM entry_tags t
      WHERE t.filename = e.filename)
  || 'related:' || chr(10) || 'updatedAt: "{{AS_OF}}"' || chr(10) || 'sourceFiles:' || chr(10)
  || (SELECT string_agg('  - ' || path || chr(10), '' ORDER BY path) FROM sources s
      WHERE s.filename = e.filename) || '---' AS header FROM entries e),
docs AS (SELECT filename, header || chr(10) || chr(10) || content || chr(10) AS document
  FROM headers JOIN body_redacted USING (filename))""".replace("{AS_OF}", AS_OF)),
    "kb": (["docs"], loaded("docs", "kb", AS_OF)),
}


def sql(final: str, *needed: str) -> str:
    """``final`` behind the CTEs it needs."""
    done: list[str] = []

    def add(name: str) -> None:
        deps, _ = CTES[name]
        for d in deps:
            add(d)
        if name not in done:
            done.append(name)

    for n in needed:
        add(n)
    if not done:
        return final
    return "WITH " + ",\n".join(CTES[n][1] for n in done) + "\n" + final


# --- snapshots: the corpus before and after ---------------------------------------------------

CTES["prev"] = ([], f"prev_read AS ({readable(view_sql('snapshot_prev'))}),\n"
                + prepared("prev_read", "prev"))
CTES["now"] = ([], f"now_walked AS (SELECT path FROM ({view_sql('snapshot_now')}) "
               f"WHERE NOT {ignored('path')}),\n"
               f"now_read AS ({readable(view_sql('snapshot_now'))}),\n"
               + prepared("now_read", "now"))
CTES["changes"] = (["prev", "now"], """changes AS (
  SELECT w.path, 'added' AS status FROM now_walked w WHERE w.path NOT IN (SELECT path FROM prev)
  UNION ALL SELECT n.path, 'changed' FROM now n JOIN prev p ON n.path = p.path AND n.hash <> p.hash
  UNION ALL SELECT p.path, 'removed' FROM prev p WHERE p.path NOT IN (SELECT path FROM now_walked))""")


def planned(files: str, out: str) -> str:
    """CTEs ``{out}`` (filename, n_sources) and ``{out}_src`` of a directory plan."""
    return f"""{out}_all AS (SELECT dir, CASE WHEN flat = '_' THEN 'general.md' ELSE flat || '.md' END AS filename,
    n_sources, first_path FROM (SELECT dir, count(*) AS n_sources, min(path) AS first_path,
    regexp_replace(regexp_replace(dir, '[:/\\\\]', '_', 'g'), '_+', '_', 'g') AS flat
    FROM (SELECT path, {dirname('path')} AS dir FROM {files}) GROUP BY dir)),
{out} AS (SELECT * FROM {out}_all QUALIFY row_number() OVER (PARTITION BY filename ORDER BY first_path DESC) = 1),
{out}_src AS (SELECT filename, path FROM (SELECT path, {dirname('path')} AS dir FROM {files}) JOIN {out} USING (dir))"""


CTES["prev_plan"] = (["prev"], planned("prev", "prev_plan"))
CTES["now_plan"] = (["now"], planned("now", "now_plan"))
CTES["stale"] = (["changes", "prev_plan"], """stale AS (SELECT DISTINCT filename FROM (
  SELECT filename FROM prev_plan_src WHERE path IN (SELECT path FROM changes)
  UNION ALL SELECT 'assistant-note.md'))""")
