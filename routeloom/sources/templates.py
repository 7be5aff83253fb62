"""Templates as tables of files: which files patterns name, their text without actions, what they include, and the URLs in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import traverse

# Attributes that hold URLs.
URL_ATTRIBUTES = ("href", "src", "action", "hx-get", "hx-post", "hx-put", "hx-patch", "hx-delete")


def glob_pattern(glob: Column) -> Column:
    """A file pattern as a regular expression: a star and a question mark stay in one folder."""
    plain = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(plain, r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("$"))


def matching_files(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(source, path): files (path) that patterns (source, glob) name. Joined by folder, as no pattern crosses one."""
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    named = patterns.select("source", "glob", folder(F.col("glob")).alias("folder"))
    return named.join(files.select("path", folder(F.col("path")).alias("folder")), "folder").filter(F.regexp_like("path", glob_pattern(F.col("glob")))).select("source", "path").distinct()


def flattened(templates: DataFrame) -> DataFrame:
    """(name, text, uses) of templates (name, text): actions taken out with both branches kept, values as {?}, and the templates included."""
    text = F.regexp_replace("text", r"(?s)\{\{-?\s*/\*.*?\*/\s*-?\}\}", "")
    uses = F.regexp_extract_all(text, F.lit(r'\{\{-?\s*(?:template|block)\s+"([^"]+)"'), F.lit(1))
    keep = F.regexp_replace(text, r'(?s)\{\{-?\s*(?:if|else|end|range|with|template|block|define|break|continue)\b[^}]*\}\}', "")
    return templates.select("name", F.regexp_replace(keep, r"(?s)\{\{[^}]*\}\}", "{?}").alias("text"), F.array_distinct(uses).alias("uses"))


def includes(templates: DataFrame) -> DataFrame:
    """(root, node): every template with those it includes, at any depth, from flattened ones (name, uses)."""
    edges = templates.select(F.col("name").alias("src"), F.explode("uses").alias("dst")).distinct()
    known = templates.select(F.col("name").alias("dst"))
    seeds = templates.select(F.col("name").alias("root"), F.col("name").alias("node"))
    return traverse.closure(seeds, edges.join(known, "dst", "left_semi")).select("root", "node", "depth")


def resolved_values(templates: DataFrame, values: DataFrame, anywhere: DataFrame) -> DataFrame:
    """(name, field, values): what {{.Field}} in templates (name, text) may hold, from values (scope, field, value).

    Those stored where the template is in scope, else those stored anywhere else for the field, else unknown.
    """
    fields = templates.select("name", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{\{-?\s*\.([A-Za-z_]\w*)\s*-?\}\}"), F.lit(1)))).alias("field"))
    own = values.groupBy(F.col("scope").alias("name"), "field").agg(F.array_sort(F.collect_set("value")).alias("own"))
    other = anywhere.groupBy("field").agg(F.array_sort(F.collect_set("value")).alias("other"))
    return fields.join(own, ["name", "field"], "left").join(other, "field", "left").select("name", "field", F.coalesce("own", "other", F.array(F.lit("{?}"))).alias("values"))


_TAG = r"""(?s)<([A-Za-z][A-Za-z0-9-]*)((?:\s+[^\s=>/"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*)\s*/?>"""
_ATTRIBUTE = r"""(?s)([A-Za-z][A-Za-z0-9-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def references(pages: DataFrame) -> DataFrame:
    """(id, element, attribute, url, method, kind) of pages (id, html): URLs in attributes, but for empty, local and script ones.

    A link element counts for style sheets and icons alone. The method is that of the hx attribute, of the form, or GET for a link.
    """
    tags = F.arrays_zip(F.regexp_extract_all("html", F.lit(_TAG), F.lit(1)).alias("e"), F.regexp_extract_all("html", F.lit(_TAG), F.lit(2)).alias("a"))
    rows = pages.select("id", F.posexplode(tags).alias("tag", "t")).select("id", "tag", F.lower("t.e").alias("element"), F.col("t.a").alias("text"))
    part = lambda i: F.regexp_extract_all("text", F.lit(_ATTRIBUTE), F.lit(i))
    values = F.zip_with(part(2), part(3), lambda a, b: F.concat(a, b))
    pairs = F.zip_with(F.transform(part(1), F.lower), values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    rows = rows.select("id", "tag", "element", pairs.alias("all"))
    of = lambda key: F.get(F.transform(F.filter("all", lambda x: x["k"] == key), lambda x: x["v"]), F.lit(0))
    rows = rows.select("id", "tag", "element", F.coalesce(of("method"), F.lit("GET")).alias("form"), F.lower(F.coalesce(of("rel"), F.lit(""))).alias("rel"), F.posexplode("all").alias("at", "x"))
    rows = rows.select("id", "tag", "at", "element", "form", "rel", F.col("x.k").alias("attribute"), F.col("x.v").alias("url"))
    rows = rows.filter(F.col("attribute").isin(*URL_ATTRIBUTES) & (F.col("url") != "") & ~F.col("url").startswith("#") & ~F.col("url").startswith("javascript:"))
    rows = rows.filter((F.col("element") != "link") | F.col("rel").contains("stylesheet") | F.col("rel").contains("icon"))
    method = F.when(F.col("attribute").startswith("hx-"), F.upper(F.substring("attribute", 4, 10))).when((F.col("element") == "form") & (F.col("attribute") == "action"), F.upper("form")).when(F.col("element") == "a", "GET").otherwise("")
    return rows.select("id", "tag", "at", "element", "attribute", "url", method.alias("method"), X.reference_kind(F.col("element"), F.col("attribute")).alias("kind"))
