"""Relations that analysis derives from facts: matched requests, dispatch, implementations, sinks, schemas and linked statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.staging import staged
from . import statements, trie


def match_requests(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(id, route, score) of requests (id, method, values) against routes (key, seq, method, patterns): the best fit, the first of equals.

    Paths and patterns are brought together once each by a trie of segments, scored once for each pair, and joined back to the
    requests and routes that have them.
    """
    wanted = requests.select("id", F.col("method").alias("wanted"), F.posexplode("values").alias("v", "url")).withColumn("path", X.url_path(F.col("url"))).filter("path <> ''")
    wanted = staged(wanted.select("id", "wanted", "v", "path"), "wanted")
    known = staged(routes.select(F.col("key").alias("route"), "seq", "method", F.posexplode("patterns").alias("p", "pattern")), "known")
    scored = trie.candidates(wanted.select("path"), known.select("pattern")).withColumn("score", X.match_score(F.col("pattern"), F.col("path"))).filter("score > 0")
    pairs = wanted.join(staged(scored, "scored"), "path").join(known, "pattern").filter((F.col("method") == F.col("wanted")) | (F.col("method") == "ANY") | ((F.col("wanted") == "") & (F.col("method") == "GET")))
    best = pairs.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "v", "seq", "p", "route")).alias("b"))
    return requests.select("id").join(best, "id", "left").select("id", F.col("b.route").alias("route"), (-F.col("b.s")).alias("score"))


def resolve_shapes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(id, route) of requests (id, key) to routes (key): the same key, else the only route of that shape; null for none or several."""
    exact = routes.select("key", F.col("key").alias("exact")).distinct()
    shapes = routes.select("key").distinct().groupBy(X.request_shape(F.col("key")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("only"))
    rows = requests.join(exact, "key", "left").withColumn("shape", X.request_shape(F.col("key"))).join(shapes.filter("n = 1"), "shape", "left")
    return rows.select("id", F.coalesce("exact", "only").alias("route"))


def _classes(rows: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Members (key, label) and classes (label, size, methods) of rows (key, method): keys of the same methods share a class."""
    sets = rows.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("method")).alias("methods"))
    sets = staged(sets, "methods")
    classes = staged(sets.select("size", "methods").distinct().withColumn(label, F.monotonically_increasing_id()), "classes")
    return staged(sets.join(classes, ["size", "methods"]).select(key, label), "members"), classes


def implements(types: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(type, interface): types (type, method) that have all methods of interfaces (interface, method).

    Types and interfaces of the same methods are one class each. A class of interfaces meets the classes of types that have its
    rarest method; bits of the methods tell most others apart before the methods are compared.
    """
    own, kinds = _classes(types, "type", "_t")
    faces, wanted = _classes(interfaces.filter("interface IS NOT NULL"), "interface", "_i")
    bits = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(m), F.lit(64)).cast("int"))))
    held = staged(kinds.select("_t", F.col("methods").alias("_has"), bits(F.col("methods")).alias("_bits")), "held")
    # few rows lead to many: they are spread before they do
    each = held.repartition(4 * held.sparkSession.sparkContext.defaultParallelism).select("_t", "_has", "_bits", F.explode("_has").alias("method"))
    often = held.select(F.explode("_has").alias("method")).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.filter("size = size(methods)").select("_i", F.explode("methods").alias("method")).join(often, "method", "left").groupBy("_i").agg(F.min_by("method", F.struct(F.coalesce("n", F.lit(0)), "method")).alias("method"))
    asked = staged(rarest.join(wanted, "_i").select("_i", "method", "methods", bits(F.col("methods")).alias("_asks")), "asked")
    pairs = each.join(asked, "method").filter((F.col("_bits").bitwiseAND(F.col("_asks")) == F.col("_asks")) & (F.size(F.array_except("methods", "_has")) == 0))
    return pairs.select("_t", "_i").join(own, "_t").join(faces, "_i").select("type", "interface")


def dispatch(calls: DataFrame, relation: DataFrame, methods: DataFrame, module: DataFrame) -> DataFrame:
    """(call, method): calls (call, interface, name) to the methods (type, name, method) of types that implement the interface.

    An interface that isn't of the module (name) dispatches to types of the module only. A call that stands once meets methods
    that stand once without repeats; only the others are brought together to be told once.
    """
    own = staged(module.select("name").distinct(), "module")
    mine = relation.join(own.select(F.col("name").alias("type"), F.lit(True).alias("type_in")), "type", "left").join(own.select(F.col("name").alias("interface"), F.lit(True).alias("face_in")), "interface", "left")
    mine = mine.filter(F.coalesce("face_in", F.lit(False)) | F.coalesce("type_in", F.lit(False)))
    single = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(f"n > 1 OR {key} IS NULL").select(F.col(key).alias("_key"), F.lit(True).alias("_many"))
    calls, methods = staged(calls.select("call", "interface", "name").distinct(), "calls"), staged(methods.select("type", "name", "method").distinct(), "type-methods")
    marked = lambda df, key: staged(df.join(single(df, key), F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_many", F.coalesce("_many", F.lit(False))).drop("_key"), "marked")
    calls, methods = marked(calls, "call"), marked(methods, "method")
    alone = methods.filter("_many").isEmpty() and calls.filter("_many").isEmpty()
    meet = lambda c, m: mine.join(c.drop("_many"), "interface").join(m.drop("_many"), ["type", "name"]).select("call", "method")
    once = meet(calls.filter("NOT _many"), methods.filter("NOT _many"))
    if alone:
        return once
    return once.union(meet(calls.filter("_many"), methods).union(meet(calls.filter("NOT _many"), methods.filter("_many"))).distinct())


def kept_references(references: DataFrame, tables: DataFrame) -> DataFrame:
    """Foreign keys (child, parent, ...) whose parent table exists."""
    return references.join(tables.select(F.col("table").alias("parent")), "parent", "left_semi")


def sinks(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls (call, callee, args) to sinks by rules (callee, kind, arg, rebind): the argument's values, with placeholders numbered."""
    found = calls.join(F.broadcast(rules), "callee")  # rules come from a configuration
    text = F.get("args", F.col("arg"))
    return found.select("call", "kind", "callee", F.when(F.col("rebind"), X.positional(text)).otherwise(text).alias("detail"))


def named_statements(calls: DataFrame) -> DataFrame:
    """(call, name, sql): interface calls (call, text) whose constant text is a named statement."""
    return calls.filter(F.col("text").startswith("-- name: ")).select("call", F.regexp_extract("text", r"^-- name: (\S+)", 1).alias("name"), F.regexp_replace("text", r"^[^\n]*\n?", "").alias("sql"))


# What the last call of an ORM chain does.
FINISHERS = {"Create": "insert", "CreateInBatches": "insert", "Save": "insert,update", "First": "select", "Find": "select", "FindInBatches": "select", "Take": "select", "Last": "select", "Scan": "select", "Pluck": "select", "Count": "select", "Row": "select", "Rows": "select", "FirstOrCreate": "select,insert", "FirstOrInit": "select", "Update": "update", "Updates": "update", "UpdateColumn": "update", "UpdateColumns": "update", "Delete": "delete"}


# Finishers whose first argument is the model or a list of it.
TAKES_MODEL = ("First", "Take", "Last", "Find", "FindInBatches", "FirstOrInit", "Create", "CreateInBatches", "Save", "FirstOrCreate", "Delete")


def chain_uses(chains: DataFrame) -> DataFrame:
    """(call, table, op) of ORM chains (call, method, model, table[, argument]); raw statements are left out.

    The table is the named one, else the model's, else for finishers that take a model that of the type of the first argument.
    """
    ops = F.split(F.element_at(F.create_map(*[F.lit(x) for p in FINISHERS.items() for x in p]), F.col("method")), ",")
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in chains.columns else F.lit("")
    model = F.when(text("model") != "", text("model")).when(F.col("method").isin(*TAKES_MODEL), F.regexp_replace(text("argument"), r"^.*[.*&\[\]]", "")).otherwise("")
    name = F.when(text("table") != "", F.col("table")).when(model != "", X.plural(X.snake_case(model)))
    return chains.filter(F.col("method").isin(*FINISHERS)).select("call", name.alias("table"), F.explode(ops).alias("op")).filter("table IS NOT NULL")


def linked(sinks: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, inferred) and edges (src, dst, op, columns) that the statements of sinks (id, sql) add to a graph with tables (table)."""
    uses = statements.uses(sinks)[2]
    used = uses.select("table").distinct().join(tables.select("table", F.lit(True).alias("known")).distinct(), "table", "left")
    nodes = used.select(X.table_id(F.col("table")).alias("id"), F.col("known").isNull().alias("inferred"))
    return nodes, uses.select(F.col("id").alias("src"), X.table_id(F.col("table")).alias("dst"), "op", F.array_join("columns", ",").alias("columns"))


REBOUND = "java.sql."  # fixed value: calls whose statements take question marks


def linked_graph(sinks: DataFrame, columns: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, detail, inferred, op, partial, broken) and edges (src, dst, kind, op, columns) of a schema and the statements linked to it.

    sinks (id, sql, callee, partial) hold the statements' texts; a sink that was partial stays so, and one without a text is
    not read. columns and references are those of schema_graph. A table that only a statement names is an inferred node.
    """
    sql = F.when(F.coalesce(F.col("callee"), F.lit("")).startswith(REBOUND), X.positional(F.col("sql"))).otherwise(F.col("sql"))
    marks, ops, uses = statements.uses(sinks.filter("sql <> ''").select("id", sql.alias("sql")))
    nodes, edges = schema_graph(columns, references)
    no, empty = F.lit(False), F.lit("")
    marked = lambda df, inferred: df.select("id", "kind", "detail", F.lit(inferred).alias("inferred"), empty.alias("op"), no.alias("partial"), no.alias("broken"))
    used = uses.select("table").distinct().join(columns.select("table").distinct(), "table", "left_anti")
    used = used.select(X.table_id(F.col("table")).alias("id"), F.lit("sql_table").alias("kind"), empty.alias("detail"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "op"))), lambda x: x["op"]), ",")
    read = marks.withColumnRenamed("partial", "_partial").join(ops.groupBy("id").agg(listed.alias("op")), "id", "left")
    read = sinks.select("id", "partial").join(read, "id", "left")
    first = F.coalesce("op", F.when(F.col("broken"), X.first_op(F.col("sql"))), empty)
    read = read.select(F.concat(F.lit("sink.sql:"), F.col("id").cast("string")).alias("id"), F.lit("sink.sql").alias("kind"), empty.alias("detail"), no.alias("inferred"), first.alias("op"), (F.coalesce("partial", no) | F.coalesce("_partial", no)).alias("partial"), F.coalesce("broken", no).alias("broken"))
    queries = uses.select(F.concat(F.lit("sink.sql:"), F.col("id").cast("string")).alias("src"), X.table_id(F.col("table")).alias("dst"), F.lit("queries").alias("kind"), "op", F.array_join("columns", ",").alias("columns"))
    return marked(nodes, False).union(marked(used, True)).union(read), edges.select("src", "dst", "kind", empty.alias("op"), empty.alias("columns")).union(queries)


def schema_graph(columns: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, detail) and edges (src, dst, kind) of a schema: columns (table, at, column, type, primary), references (table, at, columns, parent)."""
    detail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat_ws(" ", "column", "type").alias("t")))), lambda x: x["t"]), ", ")
    tables = columns.groupBy("table").agg(detail.alias("detail"))
    nodes = tables.select(X.table_id(F.col("table")).alias("id"), F.lit("sql_table").alias("kind"), "detail").union(columns.select(X.column_id(F.col("table"), F.col("column")), F.lit("sql_column"), "type"))
    edges = columns.select(X.table_id(F.col("table")).alias("src"), X.column_id(F.col("table"), F.col("column")).alias("dst"), F.lit("has_column").alias("kind"))
    kept = kept_references(references.withColumnRenamed("table", "child"), columns.select("table").distinct())
    return nodes, edges.union(kept.select(X.table_id(F.col("child")), X.table_id(F.col("parent")), F.lit("fk")))


def column_flags(columns: DataFrame, references: DataFrame) -> DataFrame:
    """(table, at, line): a table's columns as lines of an ER diagram, with PK and FK marks; references (table, column)."""
    fk = references.select("table", "column", F.lit("FK").alias("fk")).distinct()
    marks = F.array_join(F.array_compact(F.array(F.when(F.col("primary"), "PK"), F.col("fk"))), ", ")
    rows = columns.join(fk, ["table", "column"], "left")
    kind = F.regexp_replace("type", r"[^A-Za-z0-9_\[\]]", "_")
    return rows.select("table", "at", F.concat_ws(" ", kind, F.col("column"), F.when(marks != "", marks)).alias("line"))


def merge_values(uses: DataFrame) -> DataFrame:
    """(id, ops, tables, partial, error) of readings (id, seq, op, tbl, columns, partial, error), one for each value of a statement.

    Ops and tables in the order they first appear, a write before a select, columns united in order, partial if any is, the first error.
    """
    place = F.array_sort(F.collect_list(F.struct("seq", "op")))
    ops = uses.groupBy("id").agg(F.array_join(F.array_distinct(F.transform(place, lambda x: x["op"])), ",").alias("ops"), F.bool_or("partial").alias("partial"), F.min_by("error", F.when(F.col("error") != "", F.col("seq"))).alias("error"))
    table = uses.groupBy("id", "tbl").agg(F.min("seq").alias("seq"), F.coalesce(F.min_by("op", F.when(F.col("op") != "select", F.col("seq"))), F.lit("select")).alias("op"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "columns"))), lambda x: x["columns"]))).alias("columns"))
    use = F.concat(F.col("tbl"), F.lit(":"), F.col("op"), F.lit("["), F.array_join("columns", " "), F.lit("]"))
    tables = table.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", use.alias("u")))), lambda x: x["u"]), " ").alias("tables"))
    return ops.join(tables, "id").select("id", "ops", "tables", "partial", F.coalesce("error", F.lit("")).alias("error"))


def language_groups(registrations: DataFrame) -> DataFrame:
    """(call, method, pattern, variants) of registrations (call, seq, method, path): those of a call and a method that differ in the language alone are one."""
    shape = X.collapse_language(F.col("path"))
    rows = registrations.withColumn("shape", shape).groupBy("call", "method", "shape").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda x: x["path"])).alias("paths"))
    single = F.size("paths") == 1
    return rows.select("call", "method", F.when(single, F.get("paths", F.lit(0))).otherwise(F.col("shape")).alias("pattern"), F.when(single, "").otherwise(F.array_join("paths", " ")).alias("variants"))


def covered(sets: DataFrame) -> DataFrame:
    """Modules (module, dir) whose folders are not all in another module's, and of equal ones the first.

    Modules of equal folders are one class, and a class meets those alone that hold the rarest of its folders. A missing folder
    counts as one that no other module has.
    """
    own = sets.distinct().groupBy("module").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("dir")).alias("dirs"))
    own = staged(own, "folders")
    classes = staged(own.filter("module IS NOT NULL").groupBy("dirs", "size").agg(F.min("module").alias("first")), "classes")
    whole = classes.filter("size = size(dirs)")
    held = classes.select(F.explode("dirs").alias("dir"), F.col("dirs").alias("other_dirs"), F.col("size").alias("other_size"))
    often = held.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    rarest = whole.select("dirs", F.explode("dirs").alias("dir")).join(often, "dir").groupBy("dirs").agg(F.min_by("dir", F.struct("n", "dir")).alias("rarest"), F.first(F.size("dirs")).alias("_size"))
    more = (F.col("rarest") == F.col("dir")) & (F.col("other_size") > F.col("_size")) & (F.size(F.array_except("dirs", "other_dirs")) == 0)
    inside = rarest.join(held, more, "left_semi").select("dirs", F.lit(True).alias("inside"))
    first = whole.join(inside, "dirs", "left").select("dirs", "size", F.when(F.col("inside").isNull(), F.col("first")).alias("first"), F.lit(True).alias("known"))
    kept = own.join(first, ["dirs", "size"], "left").filter("module IS NULL OR known IS NULL OR module = first")
    return kept.select("module", "size")


def access_group(access: Column, optional: Column) -> Column:
    """Group of a route on the site map: public ones that know their user are of a group of their own."""
    return F.when((access == "public") & (optional == "true"), "optional").otherwise(access)
