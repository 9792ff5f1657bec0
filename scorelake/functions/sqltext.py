"""SQL text utilities: comments, statements, templates, select lists, a small dialect lint. Driver-side text, no data."""

from __future__ import annotations

import re
from collections.abc import Iterator


def tokens(sql: str) -> Iterator[tuple[str, str]]:
    """(kind, text): string, name, hint, block, line or char. Strings know doubled quotes; a block ends at its first end."""
    at, n = 0, len(sql)
    while at < n:
        two = sql[at : at + 2]
        if sql[at] in "'\"`":
            end, quote = at + 1, sql[at]
            while end < n:
                if sql[end] == quote:
                    if quote != "`" and sql[end + 1 : end + 2] == quote:
                        end += 2
                        continue
                    break
                end += 1
            yield ("string" if quote == "'" else "name"), sql[at : end + 1]
            at = end + 1
        elif two == "--":
            end = min((i for i in (sql.find("\n", at), sql.find("\r", at)) if i >= 0), default=n)
            yield "line", sql[at:end]
            at = end
        elif two == "/*":
            end = sql.find("*/", at + 2)
            end = n if end < 0 else end + 2
            closed = sql[at:end].endswith("*/") and end - at >= 4
            kind = "hint" if sql.startswith("/*+", at) and closed else "block" if closed else "char"
            if kind == "char":  # an unclosed block is no comment
                end = at + 2
            yield kind, sql[at:end]
            at = end
        else:
            yield "char", sql[at]
            at += 1


def remove_comments(sql: str) -> str:
    return "".join(text for kind, text in tokens(sql) if kind not in ("line", "block"))


def split_statements(sql: str) -> list[str]:
    """Statements between semicolons outside of strings and comments."""
    out, now = [], []
    for kind, text in tokens(sql):
        if kind == "char" and text == ";":
            out.append("".join(now).strip())
            now = []
        else:
            now.append(text)
    return [s for s in [*out, "".join(now).strip()] if s]


def split_fields(select_list: str) -> list[str]:
    """Items of a select list: commas at depth 0."""
    out, now, depth = [], [], 0
    for kind, text in tokens(select_list):
        if kind == "char":
            depth += (text in "([{") - (text in ")]}")
            if text == "," and depth == 0:
                out.append("".join(now).strip())
                now = []
                continue
        now.append(text)
    return [f for f in [*out, "".join(now).strip()] if f]


def format_select(sql: str) -> str:
    """One select item a line, commas leading."""
    found = re.match(r"(?is)\s*select\s+(distinct\s+)?", sql)
    if not found:
        return sql
    depth, end, text = 0, len(sql), ""
    place = found.end()
    for kind, t in tokens(sql[place:]):
        if kind == "char":
            depth += (t in "(") - (t in ")")
        if depth == 0 and kind == "char" and re.match(r"(?i)from\b", sql[place + len(text) :]) and (not text or text[-1].isspace()):
            end = place + len(text)
            break
        text += t
    body = "\n  , ".join(split_fields(text))
    return f"{sql[: found.end()].strip()}\n    {body}\n{sql[end:].strip()}".rstrip()


def fill_template(sql: str, **values) -> tuple[str, list[str]]:
    """{name} replaced by text, for identifiers only; values belong in spark.sql(..., args=...). Also the names left."""
    for k, v in values.items():
        sql = sql.replace("{" + k + "}", str(v))
    return sql, sorted(set(re.findall(r"\{(\w+)\}", sql)))


def load_sql(path: str | None = None, query: str | None = None, split: bool = False, select: bool = False, **values):
    """A template's statement, or statements, without comments and filled."""
    if path:
        with open(path, encoding="utf-8") as f:
            query = f.read()
    text, _ = fill_template(remove_comments(query or ""), **values)
    parts = [format_select(s) if select else s for s in split_statements(text)]
    return parts if split else ";\n".join(parts)


def select_list(names: list[str], exclude: tuple[str, ...] = (), prefix: str = "", quote: bool = False) -> str:
    wrap = (lambda n: f"`{n}`") if quote else str
    return ", ".join(f"{prefix}.{wrap(n)}" if prefix else wrap(n) for n in names if n not in exclude)


#: Constructs of Hive or Spark SQL that DuckDB does not run, each with what to use there.
DIALECT = {
    r"\blateral\s+view\b": "unnest in FROM",
    r"\bcollect_(list|set)\s*\(": "list or list(distinct ...)",
    r"\bdistribute\s+by\b|\bcluster\s+by\b|\bsort\s+by\b": "ORDER BY",
    r"\bnvl2?\s*\(": "coalesce or CASE",
    r"\bdate_(add|sub)\s*\(": "interval arithmetic",
    r"\bfrom_unixtime\s*\(|\bunix_timestamp\s*\(": "to_timestamp or epoch",
    r"\bget_json_object\s*\(": "json_extract_string",
    r"\brlike\b": "regexp_matches",
    r"\binsert\s+overwrite\b": "DELETE and INSERT",
    r"\bpartitioned\s+by\b|\bstored\s+as\b": "a plain table",
    r"\bpercentile(_approx)?\s*\(": "quantile_cont or approx_quantile",
    r"\bsize\s*\(": "len",
    r"`": "double quotes around names",
}


def dialect_issues(sql: str) -> list[tuple[int, str, str]]:
    """(line, construct, what to use) for text outside of strings and comments."""
    kept = "".join(t if k in ("char", "name") else re.sub(r"[^\n]", " ", t) for k, t in tokens(sql))
    out = [(kept.count("\n", 0, m.start()) + 1, m[0], use) for pattern, use in DIALECT.items() for m in re.finditer(pattern, kept, re.I)]
    return sorted(out)
