"""Schemas from migration texts: definitions are read into rows of changes by patterns, and replayed in order for each database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.flow import by_root
from ..operators.statements import cleaned, plain

_NAME = r'(?:[A-Za-z_][\w$]*+|"[^"]+")'
_TABLE = rf"{_NAME}(?:\.{_NAME})?"
# Short names of types.
TYPES = {"bigint": "int8", "int": "int4", "integer": "int4", "smallint": "int2", "boolean": "bool", "real": "float4", "double precision": "float8", "decimal": "numeric", "char": "bpchar", "character": "bpchar", "character varying": "varchar", "timestamp with time zone": "timestamptz", "timestamp without time zone": "timestamp", "time with time zone": "timetz", "time without time zone": "time"}
_TYPE = rf"(?i)^({_NAME})\s+(double\s+precision|character\s+varying|(?:timestamp|time)\s*(?:\(\d+\)\s*)?with(?:out)?\s+time\s+zone|{_TABLE})\s*(?:\([^()]*\))?\s*((?:\[\d*\])*)"
CHANGE = "table string, action string, name string, columns array<string>, parent string, parent_columns array<string>, type string, not_null boolean, on_delete string, is_unique boolean"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _names(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: plain(F.trim(x))), lambda x: x != "")


def _change(table: Column, action, name=None, columns=None, parent=None, parent_columns=None, kind=None, not_null=None, on_delete=None, unique=None) -> Column:
    none, empty = F.lit(""), F.array().cast("array<string>")
    pick = lambda v, other: other if v is None else v
    return F.struct(table.alias("table"), (F.lit(action) if isinstance(action, str) else action).alias("action"), pick(name, none).alias("name"), pick(columns, empty).alias("columns"), pick(parent, none).alias("parent"), pick(parent_columns, empty).alias("parent_columns"), pick(kind, none).alias("type"), pick(not_null, F.lit(False)).alias("not_null"), pick(on_delete, none).alias("on_delete"), pick(unique, F.lit(False)).alias("is_unique"))


def _element(table: Column, text: Column) -> Column:
    """Changes that a column or a constraint makes: at most four."""
    is_constraint = text.rlike(r"(?i)^(constraint\s|primary\s+key|unique\s*\(|foreign\s+key|check\s*\(|exclude\s)")
    own = plain(_first(text, rf"(?i)^constraint\s+({_NAME})"))
    words = F.regexp_replace(F.lower(_first(text, _TYPE, 2)), r"\s*\(\d+\)|\s+", " ")
    short = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in TYPES.items() for x in p]), F.trim(F.regexp_replace(words, " +", " "))), F.regexp_replace(words, r"^pg_catalog\.", ""))
    kind = F.concat(short, F.when(_first(text, _TYPE, 3) != "", "[]").otherwise(""))
    column = plain(_first(text, rf"^({_NAME})"))
    primary, unique, refers = text.rlike(r"(?i)\bprimary\s+key\b"), text.rlike(r"(?i)\bunique\b"), text.rlike(r"(?i)\breferences\b")
    listed = lambda word: _names(_first(text, rf"(?i)\b{word}\s*\(([^()]*)\)"))
    columns = lambda word: F.when(is_constraint, listed(word)).otherwise(F.array(column))
    inline = plain(_first(text, rf"(?i)\bconstraint\s+({_NAME})\s+(?:references|unique|primary)"))
    name = F.when(is_constraint, own).otherwise(inline)
    parent = plain(_first(text, rf"(?i)\breferences\s+({_TABLE})"))
    action = F.regexp_replace(F.lower(_first(text, r"(?i)\bon\s+delete\s+(cascade|set\s+null|set\s+default|restrict)")), r"\s+", " ")
    return F.array_compact(F.array(
        F.when(~is_constraint & ~text.rlike(r"(?i)^like\s"), _change(table, "column", column, kind=kind, not_null=primary | text.rlike(r"(?i)\bnot\s+null\b"))),
        F.when(primary, _change(table, "primary", name, columns(r"primary\s+key"))),
        F.when(unique, _change(table, "index", name, columns("unique"), unique=F.lit(True))),
        F.when(refers, _change(table, "reference", name, columns(r"foreign\s+key"), parent, _names(_first(text, rf"(?i)\breferences\s+{_TABLE}\s*\(([^()]*)\)")), on_delete=action)),
    ))


def _indexed(text: Column) -> Column:
    """Columns of an index; expressions have none."""
    plain_ = F.filter(F.split(text, _COMMA), lambda x: ~x.contains("("))
    return F.filter(F.transform(plain_, lambda x: plain(F.regexp_extract(F.trim(x), rf"^({_NAME})", 1))), lambda x: x != "")


_COMMA = r"\s*,(?![^()]*\))\s*"  # a comma outside brackets


def changes(files: DataFrame) -> DataFrame:
    """(db, seq, n, i, table, action, ...) of files (db, seq, sql): what each definition changes, in order. Other statements change nothing."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = files.select("db", "seq", F.posexplode(F.split(cleaned(F.col("sql")), ";")).alias("n", "text")).select("db", "seq", "n", text.alias("text"))
    t = F.col("text")
    head = rf"(?i)^create\s+(?:(?:global|local)\s+)?(?:(?:temp|temporary|unlogged)\s+)?table\s+(?:if\s+not\s+exists\s+)?({_TABLE})\s*\((.*)\)[^()]*$"
    made = plain(_first(t, head))
    create = F.concat(F.array(_change(made, "create")), F.flatten(F.transform(F.split(_first(t, head, 2), _COMMA), lambda x: _element(made, F.trim(x)))))
    alter = rf"(?i)^alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?({_TABLE})\s+(.*)$"
    altered = plain(_first(t, alter))

    def command(x: Column) -> Column:
        named = lambda p: plain(_first(x, p))
        drop, rename = rf"(?i)^drop\s+(?:column\s+)?(?:if\s+exists\s+)?({_NAME})", rf"(?i)^rename\s+(?:column\s+)?({_NAME})\s+to\s+({_NAME})"
        return (
            F.when(x.rlike(r"(?i)^add\s"), _element(altered, F.regexp_replace(x, r"(?i)^add\s+(column\s+)?(if\s+not\s+exists\s+)?", "")))
            .when(x.rlike(r"(?i)^drop\s+constraint\s"), F.array(_change(altered, "drop_constraint", named(rf"(?i)^drop\s+constraint\s+(?:if\s+exists\s+)?({_NAME})"))))
            .when(x.rlike(r"(?i)^drop\s"), F.array(_change(altered, "drop_column", named(drop))))
            .when(x.rlike(r"(?i)^rename\s+to\s"), F.array(_change(altered, "rename", named(rf"(?i)^rename\s+to\s+({_NAME})"))))
            .when(x.rlike(r"(?i)^rename\s+constraint\s"), F.array().cast(f"array<struct<{CHANGE.replace(' ', ':').replace(',:', ',')}>>"))
            .when(x.rlike(r"(?i)^rename\s"), F.array(_change(altered, "rename_column", named(rename), F.array(plain(_first(x, rename, 2))))))
        )

    commands = F.flatten(F.array_compact(F.transform(F.split(_first(t, alter, 2), _COMMA), lambda x: command(F.trim(x)))))
    index = rf"(?i)^create\s+(unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?({_NAME})?\s*on\s+(?:only\s+)?({_TABLE})\s*(?:using\s+\w+\s*)?\((.*)\)[^()]*$"
    indexed = F.array(_change(plain(_first(t, index, 3)), "index", plain(_first(t, index, 2)), _indexed(_first(t, index, 4)), unique=_first(t, index) != ""))
    gone = rf"(?i)^drop\s+(table|index)\s+(?:concurrently\s+)?(?:if\s+exists\s+)?({_TABLE}(?:\s*,\s*{_TABLE})*)"
    dropped = F.transform(_names(_first(t, gone, 2)), lambda x: _change(x, F.when(F.lower(_first(t, gone)) == "table", "drop").otherwise("drop_index"), x))
    found = F.when(t.rlike(head), create).when(t.rlike(alter), commands).when(t.rlike(index), indexed).when(t.rlike(gone), dropped)
    return rows.select("db", "seq", "n", F.posexplode(found).alias("i", "c")).select("db", "seq", "n", "i", "c.*")


_END = "\x01"  # stands in no name
STATE = "table string, part string, at int, name string, columns string, type string, detail string"


def replayed(rows: list[dict]) -> list[tuple]:
    """(table, part, at, name, columns, type, detail) after changes in order: columns, primary keys, references and indexes of every table."""
    tables: dict[str, dict] = {}
    skip = None
    for c in rows:
        here, t = (c["seq"], c["n"]), tables.get(c["table"])
        if c["action"] == "create":
            skip = here if t else None  # a table that exists stays as it is
            if not t:
                tables[c["table"]] = {"column": [], "primary": [], "reference": [], "index": []}
        elif c["action"] == "drop":
            tables.pop(c["table"], None)
        elif c["action"] == "drop_index":
            for other in tables.values():
                other["index"] = [x for x in other["index"] if x["name"] != c["name"].split(".")[-1]]
        elif t is None or here == skip:
            continue
        elif c["action"] == "column":
            if all(x["name"] != c["name"] for x in t["column"]):
                t["column"].append(dict(c))
        elif c["action"] == "primary":
            t["primary"] = list(c["columns"])
        elif c["action"] in ("reference", "index"):
            t[c["action"]].append(dict(c))
        elif c["action"] == "drop_column":
            t["column"] = [x for x in t["column"] if x["name"] != c["name"]]
            t["reference"] = [x for x in t["reference"] if c["name"] not in x["columns"]]
        elif c["action"] == "drop_constraint":
            for part in ("reference", "index"):
                t[part] = [x for x in t[part] if x["name"] != c["name"]]
        elif c["action"] == "rename_column":
            for x in t["column"]:
                x["name"] = c["columns"][0] if x["name"] == c["name"] else x["name"]
        elif c["action"] == "rename":
            tables[c["name"]] = tables.pop(c["table"])
            for other in tables.values():
                for x in other["reference"]:
                    x["parent"] = c["name"] if x["parent"] == c["table"] else x["parent"]
    out = []
    for name, t in tables.items():
        out += [(name, "column", i, x["name"], "", x["type"], "not null" if x["not_null"] else "") for i, x in enumerate(t["column"])]
        out += [(name, "primary", 0, "", ",".join(t["primary"]), "", "")] if len(t["primary"]) else []
        out += [(name, "reference", i, x["name"], ",".join(x["columns"]), x["parent"], ",".join(x["parent_columns"]) + (" " + x["on_delete"] if x["on_delete"] else "")) for i, x in enumerate(t["reference"])]
        out += [(name, "index", i, x["name"], ",".join(x["columns"]), "", "unique" if x["is_unique"] else "") for i, x in enumerate(t["index"])]
    return out


def replay(files: DataFrame) -> DataFrame:
    """(db, table, part, at, ...): the schema of each database after all its files (db, seq, sql), which are replayed as one group."""
    names = [c.split()[0] for c in CHANGE.split(", ")]
    lists = ("columns", "parent_columns")
    joined = [F.array_join(F.transform(c, lambda x: F.concat(x, F.lit(_END))), "").alias(c) for c in lists]  # plain texts are handed on faster than arrays
    spread = files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism)  # a small table of texts is much work to read
    rows = changes(spread).select("db", "seq", "n", "i", *[c for c in names if c not in lists], *joined)
    given = [c for c in rows.columns if c not in ("db", "i")]

    def run(db, found: list[tuple]) -> list[tuple]:
        made = [dict(zip(given, r)) for r in found]
        for c in made:
            c |= {k: c[k].split(_END)[:-1] for k in lists}
        return [(db, *r) for r in replayed(made)]

    return by_root(rows, ["seq", "n", "i"], given, run, f"db {files.schema['db'].dataType.simpleString()}, {STATE}", "db")
