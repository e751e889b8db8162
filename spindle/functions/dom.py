"""A tree of tags from malformed HTML, and what is read off it: signatures, names, kinds, sections.

Nothing is implied: a tag stays open until a closing tag names it or one around it, and void tags hold nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

# Tags without content.
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr".split())
# Tags that are no patterns, and that are sections.
DOCUMENT_TAGS = frozenset("html head body script style link meta".split())
SECTION_TAGS = frozenset("nav header main aside section article footer".split())
# Names of tags that hold all of some others, the first that fits.
NAMES_BY_CONTENT = (
    ("img h3 p button", "Card"),
    ("img h2 p", "FeaturedCard"),
    ("img h3 p", "MediaCard"),
    ("input button", "SearchBar"),
    ("th", "DataTable"),
    ("li", "ListItem"),
    ("h1", "PageHeader"),
    ("label input", "FormField"),
)
SHORTEST_SIGNATURE, LEVELS, WIDTH = 15, 3, 6


class Tag:
    """A tag with its attributes and its content, tags and texts."""

    __slots__ = ("name", "attributes", "content", "level")

    def __init__(self, name: str, attributes: dict[str, str], level: int):
        self.name, self.attributes, self.content, self.level = name, attributes, [], level

    @property
    def tags(self) -> list[Tag]:
        return [x for x in self.content if isinstance(x, Tag)]

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def within(self) -> Iterator[Tag]:
        """All tags inside, in their order in the document."""
        waiting = self.tags[::-1]
        while waiting:
            tag = waiting.pop()
            yield tag
            waiting += tag.tags[::-1]

    def texts(self) -> Iterator[str]:
        waiting: list = self.content[::-1]
        while waiting:
            x = waiting.pop()
            if isinstance(x, Tag):
                waiting += x.content[::-1]
            else:
                yield x

    def text(self) -> str:
        return "".join(self.texts())

    def stripped(self) -> str:
        return "".join(x.strip() for x in self.texts())

    def html(self, most: int | None = None) -> str:
        """The tag written out, cut at so many characters."""
        out, size, waiting = [], 0, [self]
        while waiting and (most is None or size < most):
            x = waiting.pop()
            if isinstance(x, Tag):
                head = "".join([f"<{x.name}", *(f' {k}="{escape(v, quote=False)}"' for k, v in x.attributes.items())])
                if x.name in VOID:
                    piece = f"{head}/>"
                else:
                    piece = f"{head}>"
                    waiting.append(("close", f"</{x.name}>"))
                    waiting += [(x.name, c) if isinstance(c, str) else c for c in x.content[::-1]]
            else:
                piece = x[1] if x[0] in ("close", "script", "style") else escape(x[1], quote=False)
            out.append(piece)
            size += len(piece)
        return "".join(out)[:most]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Tag("[document]", {}, 0)
        self.open = [self.root]

    def handle_starttag(self, name, attributes):
        tag = Tag(name, {k: v or "" for k, v in reversed(attributes)}, len(self.open))
        self.open[-1].content.append(tag)
        if name not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, name, attributes):
        self.handle_starttag(name, attributes)
        if name not in VOID:
            self.open.pop()

    def handle_endtag(self, name):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == name:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].content.append(data)


def parse(html: str) -> Tag:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def signature(tag: Tag, levels: int = LEVELS) -> str:
    """The tag's name and first class, and the signatures of its first tags, some levels deep."""
    if levels == 0:
        return tag.name
    own = ".".join([tag.name, *tag.classes[:1]])
    inside = tag.tags
    return f"{own}>{','.join(signature(x, levels - 1) for x in inside[:WIDTH])}" if inside else own


def pattern_name(tag: Tag) -> str:
    """A component's name for a tag: by what it holds, else by its first class, else by itself."""
    held = {x.name for x in tag.within()}
    for needed, name in NAMES_BY_CONTENT:
        if held.issuperset(needed.split()):
            return name
    if tag.classes:
        titled = re.sub("[-_]", " ", tag.classes[0]).title().replace(" ", "")
        if titled[:1].isupper():
            return titled
    return f"{tag.name.capitalize()}Component"


def kind(tag: Tag) -> str:
    """The first kind that the tag's name or classes tell."""
    classes, name = " ".join(tag.classes).lower(), tag.name.lower()
    rules = (
        ("nav", name == "nav" or "nav" in classes),
        (name, name in ("header", "footer")),
        ("card", "card" in classes or "tile" in classes),
        ("modal", "modal" in classes or "dialog" in classes),
        ("badge", "badge" in classes or "tag" in classes),
        ("form", name == "form" or "form" in classes),
        ("table", name in ("table", "thead", "tbody")),
        ("list_item", name == "li" or "item" in classes),
    )
    return next((k for k, holds in rules if holds), "component")


def patterns(root: Tag) -> Iterator[tuple[str, Tag]]:
    """(signature, tag) of every tag that can be a pattern, in document order."""
    for tag in root.within():
        if tag.name not in DOCUMENT_TAGS and len(own := signature(tag)) >= SHORTEST_SIGNATURE:
            yield own, tag


def section_name(tag: Tag) -> str:
    heading = next((x.stripped() for x in tag.within() if re.fullmatch("h[1-6]", x.name)), "")
    if heading:
        return heading[:60]
    if tag.attributes.get("id"):
        return re.sub("[-_]", " ", tag.attributes["id"]).title()
    return tag.attributes.get("aria-label", "")[:60] or tag.name.capitalize()


def sections(root: Tag) -> Iterator[Tag]:
    return (tag for tag in root.within() if tag.name in SECTION_TAGS)


def section_texts(tag: Tag, most: int = 10) -> list[str]:
    """Texts of headings, paragraphs, links, buttons and spans: three characters at least, each once."""
    found = (" ".join(x.stripped().split()) for x in tag.within() if x.name in ("h1", "h2", "h3", "h4", "p", "a", "button", "span"))
    return list(dict.fromkeys(x for x in found if len(x) >= 3))[:most]


def split_sources(root: Tag) -> tuple[str, str]:
    """(scripts, styles) of a plain document: its script tags; its style tags and style attributes."""
    everything = list(root.within())
    scripts = [x.text().strip() for x in everything if x.name == "script"]
    styles = [x.text() for x in everything if x.name == "style"] + [x.attributes["style"] for x in everything if x.attributes.get("style")]
    return "\n".join(s for s in scripts if s), "\n".join(styles)
