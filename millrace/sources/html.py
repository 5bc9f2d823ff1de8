"""HTML to Markdown with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Elements whose content is not text, and those that end a block.
SILENT = {"script", "style", "head", "noscript", "template", "svg"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "ul", "ol", "table", "tr", "blockquote", "pre", "figure", "form"}


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.links: list[str] = []
        self.lists: list[int | None] = []
        self.pre = 0

    def block(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag, attrs) -> None:
        attrs = dict(attrs)
        if tag in SILENT:
            self.silent += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "img":
            self.out.append(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")
        elif tag == "a":
            self.links.append(attrs.get("href") or "")
            self.out.append("[")
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            if number is not None:
                self.lists[-1] = number + 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{number}. " if number is not None else "- "))
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in BLOCKS:
            self.block()
            if tag in ("ul", "ol"):
                self.lists.append(1 if tag == "ol" else None)
            elif tag == "pre":
                self.pre += 1
                self.out.append("```\n")
            elif tag == "blockquote":
                self.out.append("> ")

    def handle_endtag(self, tag) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.block()
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in BLOCKS:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            elif tag == "pre" and self.pre:
                self.pre -= 1
                self.out.append("\n```")
            self.block()

    def handle_data(self, data) -> None:
        if not self.silent:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown_py(html: str) -> str:
    """Headings, emphasis, links, images, lists, code and paragraphs; scripts, styles and heads are left out."""
    writer = _Writer()
    writer.feed(html)
    writer.close()
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ \t]+(?![-\d])", "\n", "".join(writer.out)))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@pandas_udf(StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else html_to_markdown_py(h))
