"""Main text of web pages by equivalence-class template deduction.

The structural tokens of a page are its tags with their classes and ids; an opening token has a closing one, which is implied
where an element is left open. Over the pages of a host each label has an occurrence vector (how often it occurs on each
page); labels with the same vector form an equivalence class. Classes that occur once on a page and on most pages of the
host are candidates; void elements and text-level ones without class or id are left out. A class is valid if its tokens come in the same order on most of its pages, and if no more common valid
class is interleaved with it: of two classes one lies in one slot of the other, or they lie apart. Others are dropped whole.

The tokens of a valid class divide a page into slots; a class inside a slot of another is nested there, and after its last
token that slot goes on. A slot that holds the same text on all pages belongs to the template. The main slot is an article
or main element of a valid class if there is one, else the innermost element of a valid class that holds most of the words
outside links. Hosts with fewer than MIN_PAGES pages, or without a valid slot, use the template that the same rules give over
all hosts; a page in which the main slot doesn't occur is taken from its body.

Inside the main slot the parts that are not article text go (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments, elements and slots constant over the host, unless nothing else is left), and what remains
is cut into blocks.

Vectors are summed up as (pages, occurrences, xor of a hash of page and count) for each host and token, in the tasks that
parse pages first, so a hot host is no hot group; the template table is one row for each host and joined as Spark sees fit.

Defined results: null html counts as empty and gives an empty text; pages without host share the empty host; repeated rows
get the same text; an element that is left open ends where HTML implies it, at the end of one around it or with its page; very
long pages are read whole, in the memory of one page; an empty table gives an empty result; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._common import stage, table
from .url_filter import url_host

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg)\b[^<>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^<>]*)>",  # a quoted value may hold signs of tags; else as it stands
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
SENTENCE = frozenset(("button", "select"))  # not article text, but no ends of blocks
OUTSIDE = frozenset("aside button dialog footer form head header menu nav select title".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer header login menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
LAYOUT = frozenset("area articles bar block bottom box btn button buttons col column container content entries form group header inner item items label left links list section sections panel popular post posts right row slot small stories text title top unit wrap wrapper".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
MIN_PAGES, SUPPORT = 3, 0.6

Piece = tuple[str, str, str, str]  # kind (open, close, text), name, label, text


def pieces(page: str) -> Iterator[Piece]:
    """Tags and texts of a page in order; comments, scripts and the like are left out."""
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", "", "", page[at : m.start()]
        at = m.end()
        if name := m["name"] or m["name2"]:
            name, attrs = name.lower(), m["attrs"] or m["attrs2"] or ""
            if m["end"] or m["end2"]:
                yield "close", name, "/" + name, ""
            else:
                label = name
                if "=" in attrs:
                    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)}
                    label += "".join("." + c for c in sorted(set(found.get("class", "").split())))
                    label += "#" + found["id"] if found.get("id") else ""
                yield "open", name, label, ""
    if at < len(page):
        yield "text", "", "", page[at:]


@lru_cache(1 << 16)
def is_outside(name: str, label: str) -> bool:
    """Whether an element is no article text by its name, or for a block by a class or id that is made of marks alone.

    A class like related-posts counts, as the words beside a mark may name layout; one like related-work does not.
    """
    if name in OUTSIDE:
        return True
    if len(label) == len(name) or name not in BLOCKS:
        return False
    for mark in re.split(r"[.#]", label[len(name) :].lower()):
        words = set(re.split(r"[^a-z]+", mark)) - {""}
        if words and not MARKS.isdisjoint(words) and words <= MARKS | LAYOUT:
            return True
    return False


class Open:
    """Open elements of a page with what is kept for each, and the ends that HTML implies.

    The start of a block ends an open paragraph, an item ends the item before it in its list, a cell or row the one before it in
    its table; an end tag ends its innermost open element and all in it, and counts for nothing where none is open.
    """

    def __init__(self) -> None:
        self.stack: list[tuple] = []  # name, what is kept
        self.blocks: list[int] = []  # places of blocks in stack
        self.counts: dict[str, int] = {}

    def _pop_to(self, place: int) -> list:
        ended = []
        while len(self.stack) > place:
            name, kept = self.stack.pop()
            self.counts[name] -= 1
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            ended.append(kept)
        return ended

    def start(self, name: str) -> list:
        """Ends what the start of an element ends; what was kept of it."""
        ended: list = []
        if not self.blocks or name not in BLOCKS:
            return ended
        if self.stack[self.blocks[-1]][0] == "p":
            ended += self._pop_to(self.blocks[-1])
        if ends := ENDS.get(name):
            while self.blocks and self.stack[self.blocks[-1]][0] in ends:
                ended += self._pop_to(self.blocks[-1])
        return ended

    def push(self, name: str, kept) -> None:
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, kept))
        self.counts[name] = self.counts.get(name, 0) + 1

    def end(self, name: str) -> list:
        """Ends the innermost open element of a name and all in it."""
        if not self.counts.get(name):
            return []
        place = len(self.stack) - 1
        if self.stack[place][0] == name:
            self.counts[name] -= 1
            if self.blocks and self.blocks[-1] == place:
                self.blocks.pop()
            return [self.stack.pop()[1]]
        while self.stack[place][0] != name:
            place -= 1
        return self._pop_to(place)

    def rest(self) -> list:
        return self._pop_to(0)


def slots(page: str) -> dict[str, tuple[int, int, int, int]]:
    """For each label: occurrences, and of its last element the words outside links, a hash of its text, and its depth.

    Text in elements outside the article counts for none of the elements around them.
    """
    found: dict[str, list[int]] = {}
    opened = Open()
    links = 0

    def end(e: list) -> None:
        nonlocal links
        name, label, words, state = e
        links -= name == "a"
        entry = found.setdefault(label, [0, 0, 0, 0])
        entry[1], entry[2], entry[3] = words, state & 0x7FFFFFFFFFFFFFFF, len(opened.stack)
        if opened.stack:
            parent = opened.stack[-1][1]
            parent[3] = xxhash.xxh3_64_intdigest(f"{parent[3]}:{state}")
            if not is_outside(name, label):
                parent[2] += words

    for kind, name, label, text in pieces(page):
        if kind == "open":
            found.setdefault(label, [0, 0, 0, 0])[0] += 1
            for e in opened.start(name):
                end(e)
            if name not in VOID:
                opened.push(name, [name, label, 0, 0])
                links += name == "a"
        elif kind == "close":
            for e in opened.end(name):
                end(e)
        elif opened.stack and (words := len(text.split())):
            top = opened.stack[-1][1]
            top[3] = xxhash.xxh3_64_intdigest(f"{top[3]}:{text}")
            top[2] += 0 if links else words
    for e in opened.rest():
        end(e)
    return {k: tuple(v) for k, v in found.items()}


_STATS = "host string, label string, pages long, occurrences long, vector long, words long, least long, most long, depth long"


def _statistics(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        sums: dict[tuple[str, str], list[int]] = {}
        for host, key, page in zip(*(c.to_pylist() for c in b.columns)):
            for label, (n, words, content, depth) in slots(page).items():
                mark = xxhash.xxh3_64_intdigest(f"{key}:{n}") & 0x7FFFFFFFFFFFFFFF
                for h in (host, None):
                    s = sums.setdefault((h, label), [0, 0, 0, 0, content, content, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] ^= mark
                    s[3] += words
                    s[4], s[5] = min(s[4], content), max(s[5], content)
                    s[6] += depth
        rows = [[k[0] for k in sums], [k[1] for k in sums], *([v[i] for v in sums.values()] for i in range(7))]
        names = [f.split()[0] for f in _STATS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.string() if i < 2 else pa.int64()) for i, r in enumerate(rows)], names)


def structure(page: list[Piece]) -> tuple[list[list[str]], dict[str, int]]:
    """For each piece of a page, and for its end, the structural tokens it brings, in order; and how often each label is opened."""
    counts: dict[str, int] = {}
    made: list[list[str]] = []
    opened = Open()
    for kind, name, label, _ in page:
        here: list[str] = []
        if kind == "open":
            counts[label] = counts.get(label, 0) + 1
            here = ["/" + e for e in opened.start(name)]
            here.append(label)
            if name not in VOID:
                opened.push(name, label)
        elif kind == "close":
            here = ["/" + e for e in opened.end(name)]
        made.append(here)
    made.append(["/" + e for e in opened.rest()])
    return made, counts


def tokens(page: list[Piece], classes: dict[str, str], known: tuple[list[list[str]], dict[str, int]] | None = None) -> list[list[str]]:
    """The structure of a page, held to labels in classes that occur once on it."""
    made, counts = known or structure(page)
    once = {k for k, n in counts.items() if n == 1 and k in classes}
    once |= {"/" + k for k in once}
    return [[t for t in here if t in once] if here else here for here in made]


def arrangement(made: list[list[str]], classes: dict[str, str]) -> Iterator[tuple[str, str, str]]:
    """(class, "", its tokens in order) and (class, other class, slot of the other that it lies in) on a page.

    The slot is the other's number of tokens before; "" where the tokens of the other are all before or after, "x" where the
    class lies in more than one slot.
    """
    at: dict[str, list[int]] = {}
    order: dict[str, list[str]] = {}
    for i, t in enumerate(t for here in made for t in here):
        c = classes[t.removeprefix("/")]
        at.setdefault(c, []).append(i)
        order.setdefault(c, []).append(t)
    for c, own in at.items():
        yield c, "", xxhash.xxh3_64_hexdigest(" ".join(order[c]))
        for other, theirs in at.items():
            if other != c:
                low, high = bisect(theirs, own[0]), bisect(theirs, own[-1])
                yield c, other, "x" if low != high else "" if low in (0, len(theirs)) else str(low)


def slot_of(made: list[list[str]], classes: dict[str, str]) -> list[str]:
    """For each piece of a page the slot that it lies in, named by the token before; "" outside of all classes."""
    left: dict[str, int] = {}
    for here in made:
        for t in here:
            c = classes[t.removeprefix("/")]
            left[c] = left.get(c, 0) + 1
    found: list[str] = []
    stack: list[list[str]] = []  # class, its last token
    for here in made[:-1]:
        for t in here:
            c = classes[t.removeprefix("/")]
            own = next((e for e in stack if e[0] == c), None)
            if own is None:
                own = [c, t]
                stack.append(own)
            own[1] = t
            left[c] -= 1
            if not left[c]:
                stack.remove(own)
        found.append(stack[-1][1] if stack else "")
    return found


def _of_pages(pages: DataFrame, classes: DataFrame, of_page: Callable, schema: str, merge: Callable) -> DataFrame:
    """Sums up what of_page gives for each page (host, html) with the classes of its host and with those of all hosts (host null)."""
    common = classes.filter("host IS NULL").first()
    common = dict(common.labels) if common else {}
    rows = pages.join(classes.filter("host IS NOT NULL"), "host", "left").select("host", "html", "labels")
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64()}[f.split()[1]] for f in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sums: dict[tuple, list[int]] = {}
            for host, page, labels in zip(*(c.to_pylist() for c in b.columns)):
                parts = list(pieces(page))
                known = structure(parts)
                for h, own in ((host, dict((x["label"], x["class"]) for x in labels or ())), (None, common)):
                    for key, value in of_page(parts, own, known) if own else ():
                        merge(sums, (h, *key), value)
            rows = [(*k, *v) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return rows.mapInArrow(run, schema)


def _count(sums: dict, key: tuple, value: None) -> None:
    sums.setdefault(key, [0])[0] += 1


def _least_and_most(sums: dict, key: tuple, value: int) -> None:
    s = sums.setdefault(key, [0, value, value])
    s[:] = s[0] + 1, min(s[1], value), max(s[2], value)


def _arranged(parts: list[Piece], classes: dict[str, str], known: tuple) -> Iterator[tuple[tuple, None]]:
    for row in arrangement(tokens(parts, classes, known), classes):
        yield row, None


def _slot_texts(parts: list[Piece], classes: dict[str, str], known: tuple) -> Iterator[tuple[tuple, int]]:
    texts: dict[str, list[str]] = {}
    for (kind, _, _, text), slot in zip(parts, slot_of(tokens(parts, classes, known), classes)):
        if slot:
            texts.setdefault(slot, []).append(text if kind == "text" else " ")
    for slot, runs in texts.items():
        yield (slot,), xxhash.xxh3_64_intdigest(SPACE.sub(" ", "".join(runs)).strip()) & 0x7FFFFFFFFFFFFFFF


def valid_classes(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(host, labels) of the candidates (host, label, class, pages) whose class is valid; labels holds (label, class)."""
    listed = lambda df: df.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("label", "class"))).alias("labels"))
    seen = _of_pages(pages, stage(listed(candidates), "candidates"), _arranged, "host string, class string, other string, form string, n long", _count)
    seen = seen.groupBy("host", "class", "other", "form").agg(F.sum("n").alias("n"))
    seen = seen.groupBy("host", "class", "other").agg(F.sum("n").alias("both"), F.max_by("form", F.struct("n", "form")).alias("form"), F.max("n").alias("n"))
    seen = stage(seen, "arrangements")
    sizes = candidates.select(F.col("host").alias("_host"), F.col("class").alias("_class"), "pages").distinct()
    ordered = seen.filter((F.col("other") == "") & (F.col("n") >= F.lit(SUPPORT) * F.col("both")))
    ordered = ordered.join(sizes, F.col("host").eqNullSafe(F.col("_host")) & (F.col("class") == F.col("_class"))).select("host", "class", "pages")
    # of two interleaved classes the more common one stays; each loses only to those that are ordered themselves
    crossed = seen.filter((F.col("other") != "") & (F.col("form") == "x"))
    x, y = crossed.alias("x"), crossed.alias("y")
    crossed = x.join(y, F.col("x.host").eqNullSafe(F.col("y.host")) & (F.col("x.class") == F.col("y.other")) & (F.col("x.other") == F.col("y.class"))).select("x.host", "x.class", "x.other")
    crossed = crossed.groupBy("host", "class").agg(F.collect_set("other").alias("crossed"))
    o, c = ordered.alias("o"), crossed.alias("c")
    ordered = o.join(c, F.col("o.host").eqNullSafe(F.col("c.host")) & (F.col("o.class") == F.col("c.class")), "left").select("o.host", "o.class", "o.pages", "crossed")
    ranked = ordered.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("rank"), F.col("class").alias("class"), F.col("crossed")))).alias("all"))
    start = F.array().cast("array<string>")
    kept = F.aggregate("all", start, lambda got, e: F.when(F.arrays_overlap(got, F.coalesce(e["crossed"], start)), got).otherwise(F.concat(got, F.array(e["class"]))))
    kept = ranked.select(F.col("host").alias("_host"), F.explode(kept).alias("_class"))
    return listed(candidates.join(kept, F.col("host").eqNullSafe(F.col("_host")) & (F.col("class") == F.col("_class"))).select("host", "label", "class"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, constant, labels, fixed) from pages (host, key, html): the main slot's label, the labels of constant elements, the labels of valid classes with their class, and the constant slots. The row with a null host is the template over all hosts."""
    parts = pages.select("host", "key", "html").mapInArrow(_statistics, _STATS)
    stats = parts.groupBy("host", "label").agg(*[F.sum(c).alias(c) for c in ("pages", "occurrences", "words", "depth")], F.bit_xor("vector").alias("vector"), F.min("least").alias("least"), F.max("most").alias("most"))
    of_host = W.partitionBy("host")
    stats = stats.withColumn("total", F.max("pages").over(of_host))
    slot = stats.filter((F.col("pages") >= F.lit(SUPPORT) * F.col("total")) & (F.col("total") >= F.when(F.col("host").isNull(), 1).otherwise(MIN_PAGES)) & (F.col("occurrences") == F.col("pages")))
    # void elements enclose nothing, and bare text-level ones (b, a, span) are part of a sentence
    slot = slot.withColumn("name", F.regexp_extract("label", r"^([^.#]*)", 1)).filter(~F.col("name").isin(*VOID) & (F.col("name").isin(*BLOCKS, *OUTSIDE) | F.col("label").rlike("[.#]")))
    # labels of one class have the same vector; the class is named by its first label
    slot = stage(slot.withColumn("class", F.min("label").over(W.partitionBy("host", "pages", "vector"))), "slots")
    valid = stage(valid_classes(pages, slot.select("host", "label", "class", "pages")), "valid")
    texts = _of_pages(pages, valid, _slot_texts, "host string, slot string, n long, least long, most long", _least_and_most)
    texts = texts.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    texts = texts.filter((F.col("n") >= MIN_PAGES) & (F.col("least") == F.col("most"))).groupBy(F.col("host").alias("_slot_host")).agg(F.sort_array(F.collect_list("slot")).alias("fixed"))
    inside = valid.select(F.col("host").alias("_host"), F.explode("labels").alias("_l")).select("_host", F.col("_l.label").alias("_label"))
    slot = slot.join(inside, F.col("host").eqNullSafe(F.col("_host")) & (F.col("label") == F.col("_label")))
    outside = F.udf(lambda n, lab: is_outside(n, lab), T.BooleanType())
    slot = slot.filter(~outside("name", "label"))
    slot = slot.withColumn("fixed", (F.col("least") == F.col("most")) & (F.col("pages") >= MIN_PAGES))
    most = F.max(F.when(~F.col("fixed") | (F.col("total") < MIN_PAGES), F.col("words"))).over(of_host)
    named = F.when(F.col("name") == "article", 0).when(F.col("name") == "main", 1).otherwise(2)
    main = slot.withColumn("most_words", most).filter((F.col("words") >= 0.8 * F.col("most_words")) & ~F.col("name").isin("html", "body"))
    main = main.groupBy("host").agg(F.min_by("label", F.struct(named, -F.col("depth") / F.col("pages"), "label")).alias("main"))
    fixed = slot.filter(F.col("fixed") & F.col("label").rlike("[.#]")).groupBy(F.col("host").alias("_fixed_host")).agg(F.sort_array(F.collect_set("label")).alias("constant"))
    main = main.join(fixed, F.col("host").eqNullSafe(F.col("_fixed_host")), "left").join(texts, F.col("host").eqNullSafe(F.col("_slot_host")), "left")
    valid = valid.withColumnRenamed("host", "_valid_host")
    return main.join(valid, F.col("host").eqNullSafe(F.col("_valid_host")), "left").select("host", "main", "constant", "labels", "fixed")


def main_text(page: str, main: str | None, constant: frozenset[str] = frozenset(), classes: dict[str, str] | None = None, fixed: frozenset[str] = frozenset()) -> str:
    """Text of the main slot: blocks in page order with two line ends between them. Without the slot, of the body.

    Text in a slot in fixed is left out, unless there is no other.
    """
    parts = list(pieces(page))
    if main is not None and not any(k == "open" and lab == main for k, _, lab, _ in parts):
        main = None
    if fixed and classes:
        within = slot_of(tokens(parts, classes), classes)
        left = [("text", "", "", " ") if p[0] == "text" and slot in fixed else p for p, slot in zip(parts, within)]
        return _text_of(left, main, constant) or _text_of(parts, main, constant)
    return _text_of(parts, main, constant)


def _text_of(parts: list[Piece], main: str | None, constant: frozenset[str]) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()

    opened = Open()
    inside, skipping = int(main is None), 0

    def leave(kept: str) -> None:
        nonlocal inside, skipping
        if kept == "skip":
            skipping -= 1
        elif kept == "main":
            flush()
            inside -= 1

    for kind, name, label, text in parts:
        if kind == "text":
            if inside and not skipping:
                run.append(text)
            continue
        for kept in opened.start(name) if kind == "open" else opened.end(name):
            leave(kept)
        kept = ""
        if kind == "open" and name not in VOID:
            if inside and (skipping or is_outside(name, label) or label in constant):
                kept = "skip"
            elif not inside and label == main:
                kept = "main"
            opened.push(name, kept)
        if inside and not skipping:
            if name in BLOCKS or name in OUTSIDE and name not in SENTENCE:
                flush()
            elif name == "br":
                run.append(" ")
        skipping, inside = skipping + (kept == "skip"), inside + (kept == "main")
    flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, text, n_chars) for pages (key, url, html)."""
    rows = pages.select(F.col(key), "url", F.coalesce("html", F.lit("")).alias("html"), url_host(F.col("url")).alias("_host"))
    found = stage(templates(rows.select(F.col("_host").alias("host"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "html")), "templates")
    default = found.filter("host IS NULL").first()
    made = lambda main, constant, labels, fixed: (main, frozenset(constant or ()), {x["label"]: x["class"] for x in labels or ()}, frozenset(fixed or ()))
    common = made(*default[1:]) if default else (None,)
    columns = ["main", "constant", "labels", "fixed"]
    rows = rows.join(found.filter("host IS NOT NULL").select(F.col("host").alias("_host"), *columns), "_host", "left").select(key, "url", "html", *columns)
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = []
            for page, main, *rest in zip(*(c.to_pylist() for c in b.columns[2:])):
                texts.append(main_text(page, *(made(main, *rest) if main else common)))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
