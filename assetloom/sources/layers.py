"""What scene layers in text form say: attributes with their defaults, and arcs to other layers.

A layer's text is read once, token by token, with a stack of the prims that are open; strings, comments, paths in angle
brackets and asset paths are tokens of their own, so braces within them open nothing. Every item carries its places in
the text (in characters), so a rewrite can replace just these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The words of the format that matter here.
SPECIFIERS = {"def", "over", "class"}
OPERATIONS = {"prepend", "append", "add", "delete", "reorder"}
ARCS = {"subLayers": "sublayer", "references": "reference", "payload": "payload"}

#: One row for each attribute (kind ``attribute``: its type, and its value as text if it has one) and arc (kinds of ``ARCS``;
#: ``operation`` says how its list is edited, ``value`` is the asset path).
ITEMS = "layer string, kind string, prim string, name string, type string, operation string, value string, type_start int, type_end int, start int, end int"

#: Items that a batch has when it goes out (a layer of more by itself).
BATCH = 20_000

_TOKEN = re.compile(
    r"""(?P<string>\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<asset>@@@(?:\\@@@|.)*?@@@|@[^@\n]*@)|(?P<path><[^>\n]*>)|(?P<comment>\#[^\n]*)"""
    r"""|(?P<mark>[{}()\[\]=,;])|(?P<word>[^\s"'@<>{}()\[\]=,;#]+(?:\[\])?)|(?P<other>[^\s])""",
    re.DOTALL,
)
_CLOSING = {"(": ")", "[": "]", "{": "}"}


class _Reader:
    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "comment"]
        self.at = 0
        self.items: list[tuple] = []

    def peek(self) -> str:
        """The mark that comes next, or nothing."""
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def region(self) -> tuple[int, int]:
        """(first, after) of the tokens of a value: a bracket to its end, or one token."""
        first, depth = self.at, 0
        while self.at < len(self.tokens):
            mark = self.peek()
            if mark in _CLOSING and mark:
                depth += 1
            elif mark in _CLOSING.values() and mark:
                depth -= 1
                if depth < 0:  # the bracket around it ends: there was no value
                    break
            self.at += 1
            if not depth:
                break
        return first, self.at

    def arcs(self, kind: str, operation: str, prim: str, first: int, after: int) -> None:
        for token, written, start, end in self.tokens[first:after]:
            if token == "asset":
                marks = 3 if written.startswith("@@@") and len(written) > 5 else 1
                path = written[marks:-marks]
                if path:
                    self.items.append((kind, prim, None, None, operation, path.replace("\\@@@", "@@@"), None, None, start + marks, end - marks))

    def metadata(self, prim: str) -> None:
        """What stands in parentheses after a prim or at a layer's beginning; other values are passed over."""
        self.at += 1
        words: list[str] = []
        while self.at < len(self.tokens) and self.peek() != ")":
            kind, written, _, _ = self.tokens[self.at]
            if written == "=" and kind == "mark":
                self.at += 1
                first, after = self.region()
                if self.kind() == "path" and self.tokens[first][0] == "asset":
                    self.at += 1
                if self.peek() == "(":  # the arc's offset
                    self.region()
                if words and words[-1] in ARCS:
                    operation = words[-2] if len(words) > 1 and words[-2] in OPERATIONS else "explicit"
                    self.arcs(ARCS[words[-1]], operation, prim, first, after)
                words = []
            elif self.peek() in _CLOSING and self.peek():
                self.region()
            else:
                words = [*words[-1:], written] if kind == "word" else []
                self.at += 1
        self.at += 1

    def attribute(self, words: list[tuple], prim: str) -> None:
        """After a type and a name: a value if there is one, then what is said of it."""
        (_, kind, type_start, type_end), (_, name, _, _) = words[-2:]
        value = start = end = None
        if self.peek() == "=":
            self.at += 1
            first, after = self.region()
            if after > first:
                start, end = self.tokens[first][2], self.tokens[after - 1][3]
                value = self.text[start:end]
        if self.peek() == "(":
            self.region()
        self.items.append(("attribute", prim, name, kind, None, None if value == "None" else value, type_start, type_end, start, end))

    def read(self) -> list[tuple]:
        stack, words, pending, own = [("", None)], [], None, ""  # (path of the prim, set of variants that is open)
        line = -1
        while self.at < len(self.tokens):
            kind, written, start, end = self.tokens[self.at]
            prim, variants = stack[-1]
            if words and "\n" in self.text[line:start]:
                # a declaration without a value ends with its line
                if len(words) > 1 and words[0][1] not in SPECIFIERS and words[0][1] not in OPERATIONS | {"variantSet"} and words[-2][1] not in ("uniform", "varying", "custom", "rel"):
                    self.attribute(words, prim)
                    line, words = self.tokens[self.at - 1][3], []
                    continue
                words = []
            if kind == "word":
                words.append(self.tokens[self.at])
                self.at += 1
            elif kind == "string":
                name = written.strip("\"'")
                if words and words[0][1] in SPECIFIERS:
                    pending = f"{prim}/{name}"
                elif words and words[0][1] == "variantSet":
                    own = name
                elif variants is not None:
                    pending = f"{prim}{{{variants}={name}}}"
                words = []
                self.at += 1
            elif written == "(":
                if pending is not None or len(stack) == 1:
                    self.metadata(pending or "")
                else:
                    self.region()
            elif written == "=" and len(words) > 1 and words[0][1] != "reorder":
                self.attribute(words, prim)
                words = []
            elif written == "=" and own:
                self.at += 1
            elif written == "=":
                self.at += 1
                self.region()
                words = []
            elif written == "{":
                stack.append((pending, None) if pending is not None else (prim, own or None))
                pending, own, words = None, "", []
                self.at += 1
            elif written == "}":
                if len(stack) > 1:
                    stack.pop()
                pending, own, words = None, "", []
                self.at += 1
            else:
                words = []
                self.at += 1
            line = end if self.at <= len(self.tokens) else line
        return self.items


def read_layer(text: str) -> list[tuple]:
    """The items of one layer's text: ``ITEMS`` without the layer."""
    return _Reader(text).read()


def layer_items(texts: DataFrame) -> DataFrame:
    """``ITEMS`` of the texts of layers (layer, value), read in Arrow batches. A null or empty text has none; broken text has those up to where it can be followed."""

    kinds = [pa.string()] * 7 + [pa.int32()] * 4

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows: list[tuple] = []
            for layer, text in zip(batch.column(0), batch.column(1), strict=True):
                layer = layer.as_py()
                rows += [(layer, *item) for item in read_layer(text.as_py() or "")]
                if len(rows) >= BATCH:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    names = [part.split()[0] for part in ITEMS.split(", ")]
    return texts.select("layer", "value").mapInArrow(read, ITEMS)


def attributes(items: DataFrame, name: str) -> DataFrame:
    """(layer, prim, type, x, y and the places) of an attribute: the first two numbers of its value; null where it isn't a number or a pair."""
    number = r"\s*([-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?))\s*"
    part = lambda i: F.nullif(F.coalesce(F.nullif(F.regexp_extract("value", rf"^\({number},{number}\)$", i), F.lit("")), F.regexp_extract("value", f"^{number}$", i) if i == 1 else F.lit("")), F.lit("")).cast("double")
    return items.where((F.col("kind") == "attribute") & (F.col("name") == name)).select("layer", "prim", "type", part(1).alias("x"), part(2).alias("y"), "type_start", "type_end", "start", "end")
