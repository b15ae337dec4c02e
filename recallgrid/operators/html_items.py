"""Exam questions out of saved HTML pages.

One Python step per page turns markup into raw item rows; everything that
follows (ids, option texts, answer matching, exam numbering) is Catalyst.
Two page layouts exist:

* ``quiz``: one ``div`` per question, the right option marked by class or named
  in a sentence;
* ``accordion``: one card per question, the right option marked by colour.
"""

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.text import (
    answer_label,
    parse_option,
    safe_identifier,
    stated_answer,
    strip,
)

# --- Fixed values: the marks of the two page layouts -------------------------
LINE_CLASS = "line-content"
QUIZ_ID = re.compile(r"question-\d+-\d+")
QUIZ_CLASS = re.compile(r"que.*multichoice")
QUIZ_ROW = re.compile(r"^r[0-1]$")
QUIZ_NUMBER_PREFIX = "Pregunta "
CARD_CLASSES = "gray-card accordion-item"
CARD_CLASS = "accordion-item"
CARD_TARGET = re.compile("question_")
CARD_COLOUR = "#CFFCE4"
QUIZ_TEXT = "qtext"
QUIZ_LABEL = "d-flex"
QUIZ_LETTER = "answernumber"
QUIZ_OPTION = "flex-fill"
QUIZ_NUMBER = "qno"
QUIZ_STATED = "rightanswer"
QUIZ_FEEDBACK = "generalfeedback"
CARD_TARGET_ATTRIBUTE = "data-bs-target"
CARD_LIST = "global-list"
CARD_OPTION = "mdl-radio__label"
CARD_MODAL = "modal-body"
CARD_TOPIC = "modal-title"

ITEM_SLICE = 5000
#: Tasks up to which Spark's shuffle writes a file for each and sorts nothing (spark.shuffle.sort.bypassMergeThreshold).
DEALT = 200
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}

RAW_FIELDS = (
    "idx int, raw_id string, number string, topic string, text string, images array<string>, "
    "options array<struct<letter:string,raw:string,marked:boolean>>, stated string, "
    "explanation string, error string"
)
_OPTION = pa.struct([("letter", pa.string()), ("raw", pa.string()), ("marked", pa.bool_())])
#: The same for Arrow.
_RAW = [
    *[("idx", pa.int32()), ("raw_id", pa.string()), ("number", pa.string()), ("topic", pa.string()), ("text", pa.string())],
    *[("images", pa.list_(pa.string())), ("options", pa.list_(_OPTION)), ("stated", pa.string())],
    *[("explanation", pa.string()), ("error", pa.string())],
]


#: Texts and tags without anything that asks for the tolerant parser: bare attributes, entities in them, "/>".
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][-a-zA-Z0-9]*="[^"&]*")*)[ \t\n]*>|[^<]+""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-a-zA-Z0-9]*)="([^"]*)\"""")
#: Elements whose content some versions of the parser do not read as markup.
_OPAQUE = {"script", "style", "textarea", "title", "plaintext", "iframe", "noembed", "noframes", "noscript", "xmp"}
#: Attributes of plain tags by their text; a plain dict, since the package travels to the workers by value.
_KNOWN = {}


class _Node:
    __slots__ = ("tag", "attrs", "classes", "children", "place", "end", "order")

    def __init__(self, tag, attrs, classes, order):
        self.tag, self.attrs, self.classes, self.children, self.order = tag, attrs, classes, [], order
        # Descendants are the nodes from the next place up to the end, in document order.
        self.place = len(order)
        self.end = self.place + 1
        order.append(self)

    def nodes(self, tag, test=lambda n: True):
        """Descendants with the tag that pass the test, in document order."""
        for node in self.order[self.place + 1 : self.end]:
            if node.tag == tag and test(node):
                yield node

    def with_class(self, tag, name):
        return next(self.nodes(tag, lambda n: name in n.classes), None)

    def strings(self, without=()):
        stack = self.children[::-1]
        while stack:
            child = stack.pop()
            if isinstance(child, str):
                yield child
            elif child.tag not in without:
                stack.extend(reversed(child.children))

    def text(self, joint="", without=()):
        pieces = (s.strip() for s in self.strings((*without, "script", "style")))
        return joint.join(p for p in pieces if p)


def _plain_attributes(source):
    if source not in _KNOWN:
        if len(_KNOWN) >= 4096:
            _KNOWN.clear()
        _KNOWN[source] = _attributes(_ATTRIBUTE.findall(source))
    return _KNOWN[source]


def _attributes(pairs):
    attrs = {k.lower(): v or "" for k, v in pairs}
    return attrs, attrs.get("class", "").split()


class _Tree(HTMLParser):
    def __init__(self, page):
        super().__init__()
        if not self._plain(page):
            self._begin()
            self.feed(page)
            self.close()
        self._close(0)

    def _begin(self):
        self.order = []
        self.root = self.here = _Node("", {}, [], self.order)
        self.open = [self.root]

    def _plain(self, page):
        """Reads a page of plain tags and texts, as the parser would; False at the first other thing."""
        self._begin()
        at = 0
        for piece in _PLAIN.finditer(page):
            if piece.start() != at:
                return False
            at = piece.end()
            closing, tag, attributes = piece.groups()
            if tag is None:
                text = piece.group()
                self.handle_data(html.unescape(text) if "&" in text else text)
                continue
            tag = tag.lower()
            if tag in _OPAQUE or (closing and attributes):
                return False
            if closing:
                self.handle_endtag(tag)
            else:
                self._start(tag, *_plain_attributes(attributes))
        return at == len(page)

    def _start(self, tag, attrs, classes, empty=False):
        node = _Node(tag, attrs, classes, self.order)
        self.here.children.append(node)
        if not empty and tag not in VOID:
            self.here = node
            self.open.append(node)

    def handle_starttag(self, tag, attrs):
        self._start(tag, *_attributes(attrs))

    def handle_startendtag(self, tag, attrs):
        self._start(tag, *_attributes(attrs), empty=True)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close(i)
                self.here = self.open[-1]
                return

    def _close(self, i):
        for node in self.open[i:]:
            node.end = len(self.order)
        del self.open[i:]

    def handle_data(self, data):
        # The parser hands on a bare "<" as a piece of its own; neighbours are one text.
        if self.here.children and isinstance(self.here.children[-1], str):
            self.here.children[-1] += data
        else:
            self.here.children.append(data)


def _text(node, **options):
    return node.text(**options) if node is not None else ""


def _images(node):
    found = node.nodes("img") if node is not None else ()
    return [n.attrs["src"] for n in found if n.attrs.get("src")]


def _unwrapped(page, twice):
    """Tree of the page itself when it was saved as a source listing."""
    tree = _Tree(page).root
    if LINE_CLASS not in page:
        return tree
    lines = list(tree.nodes("td", lambda n: LINE_CLASS in n.classes))
    if not lines:
        return tree
    source = "\n".join("".join(line.strings()) for line in lines)
    return _Tree(html.unescape(source) if twice else source).root


def _quiz_items(page):
    root = _unwrapped(page, twice=False)
    items = list(root.nodes("div", lambda n: QUIZ_ID.search(n.attrs.get("id", ""))))
    items = items or list(root.nodes("div", lambda n: QUIZ_CLASS.search(" ".join(n.classes))))
    for item in items:
        body = item.with_class("div", QUIZ_TEXT)
        options = []
        for row in item.nodes("div", lambda n: any(QUIZ_ROW.match(c) for c in n.classes)):
            label = row.with_class("div", QUIZ_LABEL)
            letter = label and label.with_class("span", QUIZ_LETTER)
            text = label and label.with_class("div", QUIZ_OPTION)
            if letter and text:
                options.append({"letter": letter.text(), "raw": text.text(), "marked": "correct" in row.classes})
        yield {
            "raw_id": item.attrs.get("id", ""),
            "number": _text(item.with_class("span", QUIZ_NUMBER)),
            "topic": "",
            "text": _text(body, joint=" ", without=("table",)),
            "images": _images(body),
            "options": options,
            "stated": _text(item.with_class("div", QUIZ_STATED)),
            "explanation": _text(item.with_class("div", QUIZ_FEEDBACK), joint=" "),
        }


def _card_items(page):
    root = _unwrapped(page, twice=True)
    items = list(root.nodes("div", lambda n: n.attrs.get("class") == CARD_CLASSES))
    items = items or list(root.nodes("div", lambda n: CARD_CLASS in n.classes))
    for item in items:
        target = lambda n: CARD_TARGET.search(n.attrs.get(CARD_TARGET_ATTRIBUTE, ""))
        button = next(item.nodes("button", target), None)
        listing = item.with_class("ul", CARD_LIST)
        options = []
        for entry in listing.children if listing else ():
            if not isinstance(entry, _Node) or entry.tag != "li":
                continue
            styled = next(entry.nodes("span", lambda n: n.attrs.get("style")), None)
            label = entry.with_class("span", CARD_OPTION)
            if label:
                marked = styled is not None and CARD_COLOUR in styled.attrs["style"]
                options.append({"letter": "", "raw": label.text(), "marked": marked})
        modal = item.with_class("div", CARD_MODAL)
        yield {
            "raw_id": button.attrs[CARD_TARGET_ATTRIBUTE] if button else "",
            "number": "",
            "topic": _text(item.with_class("h6", CARD_TOPIC)),
            "text": _text(next(button.nodes("b"), None)) if button else "",
            "images": _images(item),
            "options": options,
            "stated": "",
            "explanation": _text(next(modal.nodes("p"), None)) if modal else "",
        }


def _dealt(pages: DataFrame, partitions: int | None) -> DataFrame:
    """The pages over enough tasks, each of which parses its share.

    Where the rows of a scan lie in few of its partitions (one large file, say),
    so that a task would have more than twice its share, they are dealt anew by
    a hash of the whole row, which needs no sort; up to DEALT tasks Spark's
    shuffle holds no pages in memory either. Others are parsed where they are
    read. The rows of each partition are counted without reading a page.
    """
    if partitions is not None:
        return pages.repartition(partitions, *pages.columns)
    cores = pages.sparkSession.sparkContext.defaultParallelism
    counts = [r[1] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    n = sum(counts)
    if not n or max(counts) * min(cores, n) <= 2 * n:
        return pages
    return pages.repartition(min(n, max(cores, min(4 * cores, DEALT))), *pages.columns)


def raw_items(pages: DataFrame, layout: str, partitions: int | None = None) -> DataFrame:
    """One row per item of each page; a page that cannot be read gives one error row.

    ``pages`` has an ``html`` column; its other columns are repeated per item.
    The pages are dealt evenly (``_dealt``) or over ``partitions`` tasks.
    Spark bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch, and
    items leave in slices while later pages are still to be parsed.
    """
    parse = {"quiz": _quiz_items, "accordion": _card_items}[layout]
    carried = [c for c in pages.columns if c != "html"]

    def items_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = pa.schema(_RAW)

        def slice_of(batch: pa.RecordBatch, places: list[int], rows: list[dict]) -> pa.RecordBatch:
            kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(places, pa.int64())) for c in carried]
            items = pa.RecordBatch.from_pylist(rows, raw)
            return pa.RecordBatch.from_arrays([*kept, *items.columns], [*carried, *raw.names])

        for batch in batches:
            places, rows = [], []
            for place, page in enumerate(batch.column(batch.schema.get_field_index("html"))):
                try:
                    found = [{"idx": i} | item for i, item in enumerate(parse(page.as_py() or ""))]
                except (ValueError, AssertionError) as error:
                    found = [{"idx": -1, "error": str(error)}]
                rows += found
                places += [place] * len(found)
                while len(rows) >= ITEM_SLICE:
                    yield slice_of(batch, places[:ITEM_SLICE], rows[:ITEM_SLICE])
                    places, rows = places[ITEM_SLICE:], rows[ITEM_SLICE:]
            yield slice_of(batch, places, rows)

    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*carried).schema)
    schema = f"{kept_schema}, {RAW_FIELDS}" if carried else RAW_FIELDS
    return _dealt(pages, partitions).mapInArrow(items_of, schema)


def failed_pages(raw: DataFrame) -> DataFrame:
    """The quarantine: pages that could not be read."""
    return raw.where(F.col("error").isNotNull())


def _first_marked(options: Column) -> Column:
    return F.try_element_at(F.filter(options, lambda o: o["is_correct"]), F.lit(1))


def _label(option: Column) -> Column:
    return F.when(option.isNotNull(), answer_label(option["letter"], option["text"]))


def quiz_questions(raw: DataFrame) -> DataFrame:
    """Quiz items with the right option marked by class; the last mark counts."""
    options = F.transform("options", lambda o: _plain_option(o, o["marked"]))
    last = F.try_element_at(F.filter("answer_options", lambda o: o["is_correct"]), F.lit(-1))
    return _quiz_base(raw, options).withColumn("correct_answer", _label(last))


def exam_quiz_questions(raw: DataFrame) -> DataFrame:
    """Quiz items whose right option is only named in a sentence."""
    options = F.transform("options", lambda o: _plain_option(o, F.lit(False)))
    base = _quiz_base(raw, options).withColumn("stated_answer", stated_answer(F.col("stated")))
    return match_stated_answer(base)


def _plain_option(o: Column, is_correct: Column) -> Column:
    return F.struct(
        o["letter"].alias("letter"),
        o["raw"].alias("text"),
        F.lit("").alias("explanation"),
        is_correct.alias("is_correct"),
    )


def _quiz_base(raw: DataFrame, options: Column) -> DataFrame:
    return _with_identity(
        raw.withColumn("answer_options", options),
        F.col("raw_id"),
        F.replace("number", F.lit(QUIZ_NUMBER_PREFIX), F.lit("")),
        F.col("raw_id") != "",
    )


def match_stated_answer(items: DataFrame) -> DataFrame:
    """Mark the option that the stated answer names.

    In option order, the first that equals, contains or is contained in the
    stated text; else the first with the same first three words. Empty option
    texts are skipped, though they are "contained" in everything.
    """
    stated = strip(F.lower("stated_answer"))

    def words(text: Column) -> Column:
        return F.slice(F.split(strip(F.lower(text)), r"(?U)\s+"), 1, 3)

    def text_of(i: Column) -> Column:
        return strip(F.lower(F.get("answer_options", i)["text"]))

    places = F.transform("answer_options", lambda o, i: i)
    near = F.filter(
        places,
        lambda i: (text_of(i) != "") & (text_of(i).contains(stated) | stated.contains(text_of(i))),
    )
    same_words = F.filter(places, lambda i: words(text_of(i)) == words(F.col("stated_answer")))
    hit = F.when(
        stated != "",
        F.coalesce(F.try_element_at(near, F.lit(1)), F.try_element_at(same_words, F.lit(1))),
    )
    marked = F.transform(
        "answer_options",
        lambda o, i: F.struct(
            o["letter"].alias("letter"),
            o["text"].alias("text"),
            o["explanation"].alias("explanation"),
            F.coalesce(i == F.col("_hit"), F.lit(False)).alias("is_correct"),
        ),
    )
    return (
        items.withColumn("_hit", hit)
        .withColumn("answer_options", marked)
        .withColumn(
            "correct_answer", F.coalesce(_label(_first_marked(F.col("answer_options"))), F.lit(""))
        )
        .withColumn("unmatched", (stated != "") & F.col("_hit").isNull())
        .drop("_hit")
    )


def card_questions(raw: DataFrame, module: Column | None = None) -> DataFrame:
    """Accordion items; with a module the id is prefixed by it."""
    number = F.regexp_extract("raw_id", r"question_(\d+)", 1)
    question_id = number if module is None else F.concat(module, F.lit("_"), number)
    options = F.transform("options", lambda o, i: parse_option(o["raw"], i, o["marked"]))
    explanation = F.regexp_replace(
        F.replace("explanation", F.lit("&quot;"), F.lit("")), '^"+|"+$', ""
    )
    base = _with_identity(
        raw.withColumn("answer_options", options).withColumn("explanation", explanation),
        question_id,
        number,
        (number != "") & (F.size("options") > 0),
    )
    first = _label(_first_marked(F.col("answer_options")))
    return base.withColumn("correct_answer", F.coalesce(first, F.lit("")))


def _with_identity(raw, question_id, number, parsed):
    return (
        raw.where(F.col("error").isNull())
        .withColumn("question_id", question_id)
        .withColumn("question_number", number)
        .withColumn("question_text", F.col("text"))
        .withColumn("parsed", parsed)
        .drop("raw_id", "number", "text", "options", "error")
    )


def as_exam(items: DataFrame, prefix: str, source_type: str) -> DataFrame:
    """Exam identity: ``{prefix}_{safe exam name}_{id}`` and the source type."""
    safe = safe_identifier(F.lower("reconstruction_name"))
    return items.withColumn(
        "question_id", F.concat_ws("_", F.lit(prefix), safe, F.col("question_id"))
    ).withColumn("source_type", F.lit(source_type))


def attribute_values(pages: DataFrame, tag: str, attribute: str, key: str) -> DataFrame:
    """Non-empty attribute values of a tag per page, in page order (JVM only).

    Quoted or bare; the entities that URLs carry are resolved.
    """
    value = r"""(\"[^\"]+\"|'[^']+'|[^\s\"'>]+)"""
    pattern = rf"(?is)<{tag}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\s{attribute}\s*=\s*{value}"
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    return pages.select(key, F.transform(found, _plain_value).alias("values"))


def _plain_value(value: Column) -> Column:
    value = F.regexp_replace(value, r"""^[\"'](.*)[\"']$""", "$1")
    for entity, character in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(character))
    return value
