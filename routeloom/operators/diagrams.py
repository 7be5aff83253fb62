"""Diagrams as tables of lines: each line is a row with its sort key, so a diagram of any size is written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flow import by_root


def label(text: Column) -> Column:
    """Text inside quotes of a diagram."""
    return F.replace(F.replace(text, F.lit('"'), F.lit("#quot;")), F.lit("\n"), F.lit(" "))


def er_lines(tables: DataFrame, references: DataFrame) -> DataFrame:
    """(id, part, line) of tables (id, name) and references (src, dst): a block for each table, then its references."""
    name = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    blocks = tables.select("id", F.lit(0).alias("part"), F.concat(name(F.col("id")), F.lit('["'), label(F.col("name")), F.lit('"] {}')).alias("line"))
    arrows = references.select("src", "dst").distinct()
    arrows = arrows.select(F.col("src").alias("id"), F.lit(1).alias("part"), F.concat(name(F.col("src")), F.lit(" }o--|| "), name(F.col("dst")), F.lit(' : ""')).alias("line"))
    return blocks.union(arrows)


# Arrows of the site map by trigger.
ARROWS = {"form": "==>", "redirect": "-.->", "link": "-->"}


def site_map_lines(routes: DataFrame, moves: DataFrame) -> DataFrame:
    """(part, access, line): routes (id, name, method, access) in a group for each access, then moves (src, dst, trigger).

    Pages that are read have round ends, others slanted ones. A move to itself or with an end that isn't shown is left out.
    """
    key = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9]", "_")
    get = F.col("method") == "GET"
    box = F.concat(key(F.col("id")), F.when(get, '(["').otherwise('[/"'), label(F.col("name")), F.when(get, '"])').otherwise('"/]'))
    boxes = routes.select(F.lit(0).alias("part"), "access", box.alias("line"))
    shown = routes.select(F.col("id"))
    kept = moves.filter("src <> dst").join(shown, F.col("src") == F.col("id"), "left_semi").join(shown, F.col("dst") == F.col("id"), "left_semi").distinct()
    arrow = F.lit(ARROWS["link"])
    for trigger, mark in ARROWS.items():
        arrow = F.when(F.col("trigger") == trigger, mark).otherwise(arrow)
    return boxes.union(kept.select(F.lit(1), F.lit(""), F.concat_ws(" ", key(F.col("src")), arrow, key(F.col("dst")))))


def sequence_lines(trees: DataFrame) -> DataFrame:
    """(root, step, line): one call for each step of flow trees, between the lanes of caller and callee (kind of a node)."""
    lane = lambda c: F.regexp_replace(F.substring_index(c, ":", 1), r"[^A-Za-z0-9]", "_")

    def called(root: str, rows: list[tuple]) -> list[tuple]:
        nodes = {step: node for step, _, node in rows}
        return [(root, step, node, nodes.get(parent)) for step, parent, node in rows]

    rows = by_root(trees, ["step"], ["step", "parent", "node"], called, "root string, step int, node string, caller string")
    source = F.coalesce(F.col("caller"), F.col("root"))
    return rows.select("root", "step", F.concat(lane(source), F.lit("->>"), lane(F.col("node")), F.lit(": "), label(F.col("node"))).alias("line"))


_MARKS = {"cycle": " (recursive)", "ref": " (see above)", "truncated": " (depth limit)"}


def tree_lines(trees: DataFrame) -> DataFrame:
    """(root, step, line): flow trees (root, step, parent, depth, node, mark, calls) drawn with branches, one tree at a time."""

    def draw(root: str, rows: list[tuple]) -> list[tuple]:
        last = {parent: step for step, parent, *_ in rows}
        stem: dict[int, str] = {-1: ""}
        lines = []
        for step, parent, node, mark, calls in rows:
            ends = last[parent] == step
            stem[step] = stem[parent] + ("    " if ends else "│   ")
            lines.append((root, step, stem[parent] + ("└── " if ends else "├── ") + node + (f" ×{calls}" if calls > 1 else "") + _MARKS.get(mark, "")))
        return lines

    return by_root(trees, ["step"], ["step", "parent", "node", "mark", "calls"], draw, "root string, step int, line string")
