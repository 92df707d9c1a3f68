"""One parse of an XML document on the executors: shredded elements, key texts and structure.

Spark's ``xpath`` functions build a DOM for every call and know no namespaces. Here a document is
read once, event by event (expat, with namespaces resolved), and everything that is wanted of
it is gathered on the way; nothing of it is kept but that. The column functions take and give
Arrow arrays. A document that is not well formed, or uses an undeclared prefix, raises and names its beginning.

Texts are XPath's text nodes: comments, processing instructions and child elements part them,
CDATA sections and references do not; line ends are normalised.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import functions as F

BLANK = " \t\r\n"
ANY = None              # namespace argument: match the local name in whatever namespace


def parse(doc: str, start, end, text) -> None:
    """Call ``start(name, attributes)``, ``end()`` and ``text(characters)`` for a document's events, names as ``uri}local``."""
    parser = expat.ParserCreate("utf-8", "}")
    parser.buffer_text = True
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda name: end()
    parser.CharacterDataHandler = text
    # both handlers make the parser hand over the text before them
    parser.CommentHandler = lambda data: text(None)
    parser.ProcessingInstructionHandler = lambda target, data: text(None)
    try:
        parser.Parse(doc.encode("utf-8"), True)
    except expat.ExpatError as e:
        raise ValueError(f"not a well-formed document ({e}): {doc[:80]!r}") from None


class Wanted:
    """Which element names match: the local name, in one namespace ('' is none) or in any."""

    def __init__(self, names: Sequence[str], namespace: str | None):
        self.names, self.namespace = list(names), namespace
        self.known: dict[str, int] = {}

    def number(self, name: str) -> int:
        """Place of the wanted name that ``name`` matches, or -1."""
        n = self.known.get(name)
        if n is None:
            uri, _, local = name.rpartition("}")
            fits = local in self.names and self.namespace in (ANY, uri)
            n = self.known[name] = self.names.index(local) if fits else -1
            if len(self.known) > 100_000:
                self.known = {}
        return n


def read(doc: str, wanted: Wanted, root: Wanted | None, each: bool) -> tuple[list[str | None], list[str]]:
    """Texts of the first wanted element, and the first text under each of the others ('' where none).

    ``each``: every text node is a value; else every element gives one, its first text node that
    is not blank, or None. Under another root than ``root`` there are no values.
    """
    values: list[str | None] = []
    firsts: list[str | None] = [None] * (len(wanted.names) - 1)
    stack: list[tuple[int, int]] = []          # (wanted number, place of the element's value)
    held = ""
    inside = root is None

    def flush() -> None:
        nonlocal held
        if stack:
            n, place = stack[-1]
            if n == 0 and inside:
                if each:
                    values.append(held)
                elif values[place] is None and held.strip(BLANK):
                    values[place] = held
            elif n > 0 and firsts[n - 1] is None:
                firsts[n - 1] = held
        held = ""

    def start(name: str, attributes: dict) -> None:
        nonlocal inside
        if held:
            flush()
        if not stack and root is not None:
            inside = root.number(name) == 0
        n = wanted.number(name)
        stack.append((n, len(values)))
        if n == 0 and inside and not each:
            values.append(None)

    def end() -> None:
        if held:
            flush()
        stack.pop()

    def text(data: str | None) -> None:
        nonlocal held
        if data is None:
            if held:
                flush()
        else:
            held += data

    parse(doc, start, end, text)
    return values, [f or "" for f in firsts]


def shredded(element: str, scalars: Sequence[str] = (), root: str | None = None,
             namespace: str | None = ANY, each: bool = True):
    """A column function: document -> struct(values, scalars in the order given); null for null."""
    names = [element, *[s for s in scalars]]

    @F.arrow_udf("values array<string>, scalars array<string>")
    def run(docs: pa.Array) -> pa.Array:
        wanted = Wanted(names, namespace)
        top = None if root is None else Wanted([root], namespace)
        values, value_ends, keys, key_ends = [], [0], [], [0]
        for doc in docs.to_pylist():
            if doc is not None:
                found, firsts = read(doc, wanted, top, each)
                values += found
                keys += firsts
            value_ends.append(len(values))
            key_ends.append(len(keys))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.string()))
                 for x, ends in ((values, value_ends), (keys, key_ends))]
        return pa.StructArray.from_arrays(lists, ["values", "scalars"])

    return run


def root_name(doc: str) -> str:
    """Name of the root element, ``uri}local``."""
    found: list[str] = []
    parse(doc, lambda name, attributes: found or found.append(name), lambda: None, lambda data: None)
    return found[0]


class Profile:
    """Mergeable counts by element path: what a partition has seen of its documents' structure."""

    def __init__(self):
        self.paths: dict[str, list] = {}            # path -> documents, occurrences, least, most children, with text
        self.attributes: Counter = Counter()        # (path, attribute) -> occurrences

    def add(self, doc: str) -> None:
        stack: list[list] = []                      # path, children, has text
        seen: dict[str, list] = {}

        def start(name: str, attributes: dict) -> None:
            if stack:
                stack[-1][1] += 1
            path = (stack[-1][0] if stack else "") + "/" + ("{" + name if "}" in name else name)
            stack.append([path, 0, False])
            for a in attributes:
                self.attributes[path, "{" + a if "}" in a else a] += 1

        def end() -> None:
            path, children, has_text = stack.pop()
            s = seen.setdefault(path, [0, children, children, 0])
            s[0] += 1
            s[1], s[2] = min(s[1], children), max(s[2], children)
            s[3] += has_text

        def text(data: str | None) -> None:
            if data and stack and not stack[-1][2] and data.strip(BLANK):
                stack[-1][2] = True

        parse(doc, start, end, text)
        for path, (n, least, most, texts) in seen.items():
            s = self.paths.setdefault(path, [0, 0, least, most, 0])
            s[0] += 1
            s[1] += n
            s[2], s[3] = min(s[2], least), max(s[3], most)
            s[4] += texts

    def rows(self) -> list[tuple]:
        """(path, attribute or None, documents, occurrences, least, most children, with text)."""
        return ([(p, None, *s) for p, s in self.paths.items()]
                + [(p, a, 0, n, None, None, 0) for (p, a), n in self.attributes.items()])
