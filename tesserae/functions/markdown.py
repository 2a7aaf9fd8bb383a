"""Web pages as markdown, read tag by tag with a stack of open elements."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is no text of the page, those that begin a new block, and those without content.
DROPPED = ("script", "style", "noscript", "template", "head", "svg", "iframe")
BLOCKS = ("p", "div", "article", "section", "header", "footer", "main", "nav", "aside", "form", "figure", "figcaption", "address", "dl", "dt", "dd", "body", "html", "fieldset")
EMPTY = ("br", "hr", "img", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
#: Elements that an opening tag ends where they are still open: a list item ends the one before it.
ENDS = {"li": ("li", "p"), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")} | {h: ("p",) for h in HEADINGS}
#: Where the search for such an element stops.
WALLS = ("ul", "ol", "table", "div", "article", "section", "body", "nav", "blockquote")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.open: list[str] = []
        self.lists: list[int | None] = []
        self.links: list[tuple[int, str]] = []
        self.marks: list[tuple[str, int]] = []
        self.tables: list[list[list[str]]] = []
        self.quotes = 0
        self.lead = ""

    def close_line(self) -> None:
        """What has been read since the last block becomes one."""
        text = "".join(self.line)
        self.line.clear()
        self.links.clear()
        self.marks.clear()
        if "pre" not in self.open:
            text = "\n".join(x.strip() for x in re.sub(r"[^\S\n]+", " ", text).split("\n")).strip()
        if not text.strip():
            return
        if self.tables and self.tables[-1] and self.tables[-1][-1]:
            cell = self.tables[-1][-1]
            cell[-1] = f"{cell[-1]} {text}".strip().replace("\n", " ").replace("|", "\\|")
            return
        self.blocks.append("".join(f"{'> ' * self.quotes}{x}\n" for x in (self.lead + text).split("\n"))[:-1])
        self.lead = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for x in reversed(self.open):
            if x in WALLS and tag not in ("td", "th", "tr") or x == "table":
                break
            if x in ENDS.get(tag, ()):
                self.handle_endtag(x)
                break
        if tag not in EMPTY:
            self.open.append(tag)
        if any(x in DROPPED for x in self.open):
            return
        at = {k: v or "" for k, v in attrs}
        if tag in BLOCKS or tag == "pre":
            self.close_line()
        elif tag in HEADINGS:
            self.close_line()
            self.lead = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            self.close_line()
            self.lists.append(1 if tag == "ol" else None)
        elif tag == "li":
            self.close_line()
            number = self.lists[-1] if self.lists else None
            self.lead = "  " * (len(self.lists) - 1) + ("- " if number is None else f"{number}. ")
            if number is not None:
                self.lists[-1] = number + 1
        elif tag == "blockquote":
            self.close_line()
            self.quotes += 1
        elif tag == "table":
            self.close_line()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append("")
        elif tag == "a":
            self.links.append((len(self.line), at.get("href", "")))
        elif tag in MARKS and "pre" not in self.open:
            self.marks.append((tag, len(self.line)))
        elif tag == "br":
            self.line.append("\n")
        elif tag == "hr":
            self.close_line()
            self.blocks.append("---")
        elif tag == "img" and at.get("alt"):
            self.line.append(f"![{at['alt']}]({at.get('src', '')})")

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        inside = any(x in DROPPED for x in self.open)
        while True:  # elements that were left open end with the one around them
            last = self.open[-1]
            if last == "pre" and not inside:
                self.fence()
            self.open.pop()
            if not inside:
                self.ended(last)
            if last == tag:
                return

    def fence(self) -> None:
        text = "".join(self.line).strip("\n")
        self.line.clear()
        if text.strip():
            self.blocks.append(f"```\n{text}\n```")

    def ended(self, tag: str) -> None:
        if tag == "a" and self.links:
            at, href = self.links.pop()
            text = "".join(self.line[at:]).strip()
            self.line[at:] = [f"[{text}]({href})" if href and text else text]
        elif tag in MARKS and self.marks and self.marks[-1][0] == tag:
            _, at = self.marks.pop()
            text = "".join(self.line[at:])
            if text.strip():
                self.line[at:] = [MARKS[tag] + text.strip() + MARKS[tag] + (" " if text[-1].isspace() else "")]
        elif tag in BLOCKS or tag in HEADINGS or tag in ("li", "td", "th"):
            self.close_line()
            if tag in HEADINGS or tag == "li":
                self.lead = ""
        elif tag in ("ul", "ol"):
            self.close_line()
            self.lists.pop()
        elif tag == "blockquote":
            self.close_line()
            self.quotes -= 1
        elif tag == "table" and self.tables:
            self.close_line()
            rows = [r for r in self.tables.pop() if r]
            if rows:
                wide = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
                self.blocks.append("\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]))

    def handle_data(self, data: str) -> None:
        if not any(x in DROPPED for x in self.open):
            self.line.append(data if "pre" in self.open else re.sub(r"\s+", " ", data))


def markdown(html: str | None) -> str | None:
    """A page's text as markdown: headings, paragraphs, lists, links, marks, quotes, tables, code and line breaks; entities are read,
    scripts, styles, comments and the head are left out. Elements that are not ended end with the one around them. Null stays null."""
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    if any(x in DROPPED for x in reader.open):
        reader.open.clear()
    while reader.open:
        reader.handle_endtag(reader.open[-1])
    reader.close_line()
    out = ""
    for before, block in zip(["", *reader.blocks], reader.blocks, strict=False):
        item = re.compile(r"\s*(-|\d+\.) ")
        out += ("" if not out else "\n" if item.match(before) and item.match(block) else "\n\n") + block
    return out


#: Rows go to Python by the hundred: an Arrow batch of ten thousand pages would be held at once.
to_markdown = F.udf(markdown, T.StringType(), useArrow=False)
