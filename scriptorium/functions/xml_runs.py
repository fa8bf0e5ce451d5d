"""Per-document helper for E1: the four text-run lists of one article XML.

This is the small per-row Python step of the ingest job; Spark partitions the
files and runs it inside ``mapInArrow`` tasks. It drives the standard library's
expat parser, which never fetches external DTDs, and keeps no tree: what it holds
is the open elements, the text node at hand and the runs found so far.

Rules (XPath 1.0 reading of the original expressions):

* pmcid: for every element, its first ``article-id`` child, and of that the
  first text node. Several parents give several runs.
* title: for every element, its first ``title-group`` child, in it the first
  ``article-title`` child, and of that the first text node. Inline markup
  therefore ends a title.
* abstract / body: every text node below any ``abstract`` / ``body`` element,
  in document order, each once even when such elements nest.
* Comments and processing instructions split text nodes and contribute no
  text; CDATA is plain text.
* A reference to an entity that the document does not define makes it malformed.
"""

from __future__ import annotations

# Fixed element names used by the four rules.
ARTICLE_ID = "article-id"
TITLE_GROUP = "title-group"
ARTICLE_TITLE = "article-title"
ABSTRACT = "abstract"
BODY = "body"

#: Bytes given to the parser at a time.
FEED_BYTES = 1 << 20


class _Open:
    """An element that has started: what its first children were, and the run its text starts."""

    __slots__ = ("name", "has_id", "has_group", "has_title", "is_group", "slot")

    def __init__(self, name, is_group, slot):
        self.name, self.is_group, self.slot = name, is_group, slot
        self.has_id = self.has_group = self.has_title = False


class RunsReader:
    """Feed it an article piece by piece; ``close`` gives the four run lists."""

    def __init__(self):
        from xml.parsers import expat

        # The separator puts elements of a namespace under another name than plain ones.
        parser = expat.ParserCreate(namespace_separator="}")
        parser.buffer_text = True
        parser.ordered_attributes = True
        parser.StartElementHandler = self._start
        parser.EndElementHandler = self._end
        parser.CharacterDataHandler = self._text
        parser.CommentHandler = self._split
        parser.ProcessingInstructionHandler = self._split
        parser.SkippedEntityHandler = self._unknown
        self._parser = parser
        self._open: list[_Open] = []
        self._piece: list[str] = []
        self._inside = {ABSTRACT: 0, BODY: 0}
        # A run's place is taken when its element starts and filled by its first text node.
        self._runs: dict[str, list] = {"pmcid": [], "title": [], "abstract": [], "body_text": []}

    def _unknown(self, name, is_parameter):
        if not is_parameter:
            raise ValueError(f"undefined entity &{name};")

    def _text(self, data):
        if self._inside[ABSTRACT] or self._inside[BODY] or (self._open and self._open[-1].slot):
            self._piece.append(data)

    def _split(self, *_):
        """The text node at hand ends here."""
        if not self._piece:
            return
        text = "".join(self._piece)
        self._piece.clear()
        top = self._open[-1]
        if top.slot:
            name, place = top.slot
            self._runs[name][place] = text
            top.slot = None
        if self._inside[ABSTRACT]:
            self._runs["abstract"].append(text)
        if self._inside[BODY]:
            self._runs["body_text"].append(text)

    def _place(self, name):
        self._runs[name].append(None)
        return name, len(self._runs[name]) - 1

    def _start(self, name, _attributes):
        self._split()
        up = self._open[-1] if self._open else None
        is_group, slot = False, None
        if up is not None:
            if name == ARTICLE_ID and not up.has_id:
                up.has_id, slot = True, self._place("pmcid")
            elif name == TITLE_GROUP and not up.has_group:
                up.has_group, is_group = True, True
            elif name == ARTICLE_TITLE and up.is_group and not up.has_title:
                up.has_title, slot = True, self._place("title")
        self._open.append(_Open(name, is_group, slot))
        if name in self._inside:
            self._inside[name] += 1

    def _end(self, name):
        self._split()
        self._open.pop()
        if name in self._inside:
            self._inside[name] -= 1

    def feed(self, data) -> None:
        self._parser.Parse(data, False)

    def close(self) -> dict:
        self._parser.Parse(b"", True)
        return {name: [t for t in runs if t is not None] for name, runs in self._runs.items()}


def parse_runs(data: bytes) -> tuple[dict | None, str | None]:
    """Return ``({pmcid, title, abstract, body_text: list[str]}, None)`` or ``(None, reason)``."""
    from xml.parsers import expat

    reader, view = RunsReader(), memoryview(data)
    try:
        for start in range(0, len(view), FEED_BYTES):
            reader.feed(view[start:start + FEED_BYTES])
        return reader.close(), None
    except (expat.ExpatError, ValueError, LookupError) as exc:
        return None, f"malformed: {exc}"
