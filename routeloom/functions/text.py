"""Scalar functions on ids, patterns, URLs and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGE = r"^[a-z]{2}(-[A-Za-z]{2,4})?$"


UNKNOWN = "unknown_part_"  # stands for an unknown part of a statement


def node_id(kind: str, name: Column) -> Column:
    """kind:name."""
    return F.concat(F.lit(kind + ":"), name)


def split_method(pattern: Column) -> Column:
    """Method of a registration, the part before its first space; ANY where there is none or it is a path."""
    return F.when(pattern.contains(" ") & ~pattern.startswith("/"), F.substring_index(pattern, " ", 1)).otherwise("ANY")


def split_path(pattern: Column) -> Column:
    """Pattern of a registration without its method."""
    return F.when(pattern.contains(" ") & ~pattern.startswith("/"), F.regexp_replace(pattern, r"^[^ ]* +", "")).otherwise(pattern)


def collapse_language(pattern: Column) -> Column:
    """The pattern with a language code in its first segment replaced by {lang}."""
    return F.regexp_replace(pattern, r"^/[a-z]{2}(-[A-Za-z]{2,4})?(/|$)", r"/{lang}$2")


def url_path(url: Column) -> Column:
    """Path of a site URL: no query or fragment, empty for external or relative ones; an unknown prefix becomes a segment."""
    bare = F.regexp_replace(F.replace(url, F.lit("{?}"), F.lit("\u0000")), r"[?#].*$", "")
    bare = F.replace(bare, F.lit("\u0000"), F.lit("{?}"))
    return F.when(bare.contains("://"), "").when(bare.startswith("{?}/"), F.concat(F.lit("/"), bare)).when(bare.startswith("/") & ~bare.startswith("//"), bare).otherwise("")


def short_name(name: Column) -> Column:
    """A qualified function name without package folders."""
    return F.regexp_replace(name, r"^.*/", "")


def one_line(text: Column, most: int = 160) -> Column:
    """White space collapsed, cut at so many bytes of UTF-8 (a character that is cut through goes)."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(flat, "UTF-8"), 1, most).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(flat) > most, F.concat(cut, F.lit("…"))).otherwise(flat)


def position(file: Column, line: Column) -> Column:
    """file:line, or empty."""
    return F.when(F.coalesce(file, F.lit("")) == "", "").otherwise(F.concat(file, F.lit(":"), line.cast("string")))


def snake_case(name: Column) -> Column:
    """ORM column name of a field."""
    return F.lower(F.regexp_replace(name, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_"))


# Irregular plurals of table names.
IRREGULAR = {"person": "people", "man": "men", "woman": "women", "child": "children", "mouse": "mice"}


def plural(word: Column) -> Column:
    """ORM table name of a type: irregular last parts, then the regular forms."""
    last = F.substring_index(word, "_", -1)
    head = F.substring(word, F.lit(1), F.length(word) - F.length(last))
    regular = (
        F.when(word.rlike(r"[^aeiou]y$"), F.regexp_replace(word, r"y$", "ies"))
        .when(word.rlike(r"(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )
    for one, many in IRREGULAR.items():
        regular = F.when(last == one, F.concat(head, F.lit(many))).otherwise(regular)
    return regular


def hole_parameters(sql: Column) -> Column:
    """A dollar sign before unknown parts becomes a first parameter."""
    return F.regexp_replace(sql, r"\$(\{\?\})+", r"\$1")


def drop_empty_alternative(values: Column) -> Column:
    """An array without its empty string where it has another value."""
    return F.when(F.size(values) > 1, F.filter(values, lambda v: v != "")).otherwise(values)


def concat_alternatives(left: Column, right: Column, most: int = 32) -> Column:
    """All joins of two lists of alternatives; one unknown value beyond so many."""
    joined = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, b))))
    return F.when(F.size(left) * F.size(right) > most, F.array(F.lit("{?}"))).otherwise(F.array_distinct(joined))


_DDL = ("create", "alter", "drop", "truncate")
_VERBS = ("select", "insert", "update", "delete", "merge", *_DDL)
_LEADING = ("from", "join", "into", "update", "table")
_SCANNED = r'"[^"]*"|[A-Za-z_][A-Za-z_0-9$]*|\(|\)|\.|\S'


def _words(sql: Column) -> Column:
    """Names, brackets and single signs of a text, in order."""
    return F.regexp_extract_all(sql, F.lit(_SCANNED), F.lit(0))


def first_op(sql: Column) -> Column:
    """The op of a statement's first verb: its first word, or after WITH the first verb that follows a closing bracket; ddl for those that change the schema, other for what isn't known."""
    words = F.transform(_words(sql), F.lower)
    start = F.get(words, F.lit(0))
    later = F.get(F.filter(words, lambda w, i: w.isin(*_VERBS) & (i > 0) & (F.get(words, i - 1) == ")")), F.lit(0))
    verb = F.when(start == "with", later).when(start.isin(*_VERBS), start)
    return F.when(verb.isin(*_DDL), "ddl").otherwise(F.coalesce(verb, F.lit("other")))


def fallback_tables(sql: Column) -> Column:
    """(op, table) found by key words in SQL text that can't be read otherwise: tables in order, a write goes before a select.

    A table is the name after from, join, into, update or table, with what follows a dot. In a delete every table after from is
    deleted from; into takes the op of the statement.
    """
    words, op = _words(sql), first_op(sql)
    is_name = lambda w: F.coalesce(w.rlike('^("[A-Za-z_][A-Za-z_0-9$]*"|[A-Za-z_][A-Za-z_0-9$]*)$'), F.lit(False))

    def use(word: Column, i: Column) -> Column:
        lead, more = F.lower(word), F.get(words, i + 3)
        dotted = (F.get(words, i + 2) == ".") & is_name(more)
        table = F.replace(F.when(dotted, F.concat(F.get(words, i + 1), F.lit("."), more)).otherwise(F.get(words, i + 1)), F.lit('"'), F.lit(""))
        own = F.when(lead == "into", op).when(lead == "update", "update").when(lead == "table", "ddl").when((lead == "from") & (op == "delete"), "delete").otherwise("select")
        return F.when(lead.isin(*_LEADING) & is_name(F.get(words, i + 1)), F.struct(own.alias("op"), table.alias("table")))

    uses = F.filter(F.transform(words, use), lambda u: u.isNotNull() & (F.lower(u["table"]) != "select") & (u["table"] != UNKNOWN))
    writes = lambda t: F.filter(uses, lambda u: (u["table"] == t) & (u["op"] != "select"))
    return F.transform(F.array_distinct(F.transform(uses, lambda u: u["table"])), lambda t: F.struct(F.coalesce(F.get(writes(t), F.lit(0))["op"], F.lit("select")).alias("op"), t.alias("table")))


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/")


def _is_wildcard(p: Column) -> Column:
    return p.startswith("{") & p.endswith("}")


def suffix_score(pattern: Column, path: Column) -> Column:
    """Literals in common where the path's first segment is unknown and may stand for several: the rest against the pattern's end."""
    p, q = _segments(pattern), _segments(path)
    n, m = F.size(p), F.size(q)
    tail, rest = F.slice(p, F.greatest(n - m + 2, F.lit(1)), F.greatest(m - 1, F.lit(0))), F.slice(q, F.lit(2), F.greatest(m - 1, F.lit(0)))
    fit = F.zip_with(tail, rest, lambda a, b: F.when(a == b, 1).when((_is_wildcard(a) & (b != "")) | b.contains("{?}"), 0))
    return F.when((m < 2) | (F.get(q, F.lit(0)) != "{?}") | (n < m) | F.exists(fit, lambda x: x.isNull()), 0).otherwise(F.size(F.filter(fit, lambda x: x == 1)))


def match_score(pattern: Column, path: Column) -> Column:
    """How well a route pattern fits a path: 3 for an equal segment, 2 for a wildcard, 1 for an unknown one; 0 for no fit.

    A last {name...} takes the rest (one point more) if a literal came before. A fit needs a literal; where there is none, or
    a segment doesn't fit, a path with an unknown beginning may still fit the pattern's end (suffix_score).
    """
    p, q = _segments(pattern), _segments(path)
    n, m = F.size(p), F.size(q)
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("literals"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, i: Column) -> Column:
        a, b = F.get(p, i), F.get(q, i)
        tail = _is_wildcard(a) & a.endswith("...}")
        points = F.when(a == b, 3).when(_is_wildcard(a) & (b != ""), 2).when(b.contains("{?}"), 1)
        end = F.when(acc["end"].isNotNull(), acc["end"]).when(tail, F.when((i >= m) | (acc["literals"] == 0), 0).otherwise(acc["score"] + 1)).when((i >= m) | points.isNull(), -1)
        return F.struct((acc["score"] + F.coalesce(points, F.lit(0))).alias("score"), (acc["literals"] + F.coalesce((a == b).cast("int"), F.lit(0))).alias("literals"), end.alias("end"))

    def finish(acc: Column) -> Column:
        return F.coalesce(acc["end"], F.when((n != m) | (acc["literals"] == 0), -1).otherwise(acc["score"]))

    whole = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, finish)
    return F.when(pattern.isin("/", "/{$}"), F.when(path == "/", 3).otherwise(0)).when(whole < 0, suffix_score(pattern, path)).otherwise(whole)


def positional(sql: Column) -> Column:
    """Placeholders ? and :name or :name.field as $1, $2, ...; quoted text, to the end if it stays open, and casts (::) stay."""
    tokens = F.regexp_extract_all(sql, F.lit(r"""(?s)'[^']*'?|"[^"]*"?|::|:[\p{L}_][\p{L}\p{Nd}_.]*|\?|[^'"?:]+|:"""), F.lit(0))
    hole = lambda t: t.rlike(r"^(\?|:[\p{L}_])")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        n = acc["n"] + hole(t).cast("int")
        return F.struct(n.alias("n"), F.array_append(acc["out"], F.when(hole(t), F.concat(F.lit("$"), n.cast("string"))).otherwise(t)).alias("out"))

    return F.aggregate(tokens, start, step, lambda acc: F.array_join(acc["out"], ""))


def resolved(values: Column) -> Column:
    """Whether a sink's values are all known: there are some, and none has an unknown part."""
    return (F.size(values) > 0) & ~F.exists(values, lambda v: v.contains("{?}"))


def request_shape(path: Column) -> Column:
    """A route's path with unnamed parameters, for comparing requests."""
    return F.regexp_replace(path, r"\{[^}]*\}", "{}")


def table_id(table: Column) -> Column:
    """Id of a table's node."""
    return node_id("sql_table", table)


def column_id(table: Column, column: Column) -> Column:
    """Id of a column's node."""
    return node_id("sql_column", F.concat_ws(".", table, column))


def sink_id(kind: Column, file: Column, line: Column, col: Column) -> Column:
    """Id of a sink: its kind and place."""
    return F.concat_ws(":", kind, file, line.cast("string"), col.cast("string"))


# What a foreign key does on delete, by its letter.
ON_DELETE = {"c": "cascade", "n": "set null", "d": "set default", "r": "restrict"}


def fk_action(letter: Column) -> Column:
    """Name of an action; empty for others."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in ON_DELETE.items() for x in p]), letter), F.lit(""))


def in_module(package: Column, module: str) -> Column:
    """Whether a package is the module or below it."""
    return (package == module) | package.startswith(module + "/")


def external(kind: Column, flag: Column) -> Column:
    """Whether a node lies outside the module; calls through an interface are followed."""
    return (F.coalesce(flag, F.lit("")) == "true") & (kind != "interface_call")


# Elements whose URLs are assets.
ASSETS = ("script", "img", "link", "source")


def reference_kind(element: Column, attribute: Column) -> Column:
    """What a URL attribute makes: request, asset or link; empty for others, such as a frame's."""
    asks = attribute.startswith("hx-") | (element == "form") & (attribute == "action")
    return F.when(asks, "request").when(element.isin(*ASSETS), "asset").when((element == "a") & (attribute == "href"), "link").otherwise("")


def join_path(prefix: Column, path: Column) -> Column:
    """A prefix and a path with one slash between them."""
    return F.concat(F.regexp_replace(prefix, "/+$", ""), F.when(path.startswith("/") | (path == ""), path).otherwise(F.concat(F.lit("/"), path)))


_VERB = r"%[ #0+-]*[*\d]*(?:\.[*\d]+)?[%A-Za-z]"  # flags, width, precision, letter


def fold_format(text: Column, arguments: Column) -> Column:
    """A format with its verbs replaced, in order, by lists of alternatives: all results, {?} for a verb without a known value.

    Two percent signs are one and take no argument; a verb may have flags, a width and a precision.
    """
    pieces, verbs = F.split(text, _VERB, -1), F.regexp_extract_all(text, F.lit(_VERB), F.lit(0))
    start = F.struct(F.array(F.get(pieces, F.lit(0))).alias("out"), F.lit(0).alias("used"))

    def step(acc: Column, i: Column) -> Column:
        sign = F.get(verbs, i) == "%%"
        value = F.when(sign, F.array(F.lit("%"))).otherwise(F.coalesce(F.get(arguments, acc["used"]), F.array(F.lit("{?}"))))
        out = concat_alternatives(concat_alternatives(acc["out"], value), F.array(F.get(pieces, i + 1)))
        return F.struct(out.alias("out"), (acc["used"] + F.when(sign, 0).otherwise(1)).alias("used"))

    places = F.when(F.size(verbs) > 0, F.sequence(F.lit(0), F.size(verbs) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda acc: acc["out"])


def line_at(text: Column, offset: Column) -> Column:
    """Line, from 1, of a byte offset."""
    return F.regexp_count(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset).cast("string")), F.lit("\n")) + 1
