"""Lines of pages and texts as the leaves of their document tree, in plain Python."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Fixed value: elements that make a text a page, and those whose content is never shown.
_PAGE = re.compile(r"<(?:!doctype|html|head|body|div|p|span|h[1-6]|article|main|section|table|li|td)\b", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)(/?)>")
_COMMENT = re.compile(r"<!--.*?(?:-->|$)|<!doctype[^>]*>", re.I)
_NAME = re.compile(r"""\b(?:class|id)\s*=\s*["']?([^"'>\s]+)""", re.I)
BLOCKS = frozenset("html body main article section div table tbody tr td th ul ol dl aside nav footer header form figure blockquote center".split())
HIDDEN = frozenset(("head", "script", "style", "title", "template"))
VOID = frozenset("br hr img meta link input area base col embed source track wbr".split())


class Line(NamedTuple):
    no: int
    text: str  # as shown, without markup
    style: str  # element and class of the leaf, empty in plain texts
    path: tuple[int, ...]  # open block elements, by the number of their start
    heading: bool
    link: bool  # the whole text is a link
    nodes: tuple[str, ...] = ()  # presentation nodes of the leaf: the chain of styles to its element, and to what encloses that


def is_page(body: str) -> bool:
    return _PAGE.search(body) is not None


def plain_lines(text: str) -> list[Line]:
    return [Line(i, raw.strip(), "", (), False, False) for i, raw in enumerate(text.split("\n"), 1)]


def page_lines(body: str) -> list[Line]:
    """One leaf a physical line. Elements that stay open go on over the next lines."""
    out, stack, hidden, serial, carried = [], [("", (), "")], [], 0, ""
    for no, raw in enumerate(body.split("\n"), 1):
        if "<!" in raw:
            raw = _COMMENT.sub("", raw)
        texts, last, style, heading = [], 0, "", False
        _, path, inside = stack[-1]
        for m in _TAG.finditer(raw):
            if not hidden:
                texts.append(raw[last : m.start()])
            closing, name, attributes, empty = m.groups()
            last, name = m.end(), name.lower()
            if closing:
                if hidden and hidden[-1] == name:
                    hidden.pop()
                elif stack[-1][0] == name:
                    stack.pop()
                elif any([name == n for n, _, _ in stack]):
                    while stack.pop()[0] != name:
                        pass
                continue
            if name in HIDDEN and not empty:
                hidden.append(name)
                continue
            block = name in BLOCKS and not empty
            if block or not style and name not in VOID:
                got = attributes and _NAME.search(attributes)
                own = f"{name}.{got.group(1).lower()}" if got else name
                style = style or own
            heading = heading or name == "h1"
            if block:
                serial += 1
                stack.append((name, (*stack[-1][1], serial), f"{stack[-1][2]}>{own}"))
        if not hidden:
            texts.append(raw[last:])
        text = "".join(texts)
        text = (html.unescape(text) if "&" in text else text).replace("\xa0", " ").strip()
        # an element that starts and ends on the line is the leaf itself
        if len(stack[-1][1]) > len(path):
            _, path, inside = stack[-1]
        carried = style or carried
        leaf = style or (carried if text else "")
        out.append(Line(no, text, leaf, path, heading, "<a " in raw and _only_link(raw), (f"{inside}/{leaf}", inside) if text else ()))
    return out


_LINK = re.compile(r"<a\s[^>]*>(.*?)</a>", re.I)


def _only_link(raw: str) -> bool:
    outside = _TAG.sub("", _LINK.sub("", raw))
    return not re.search(r"\w", html.unescape(outside))


def lines_of(body: str, page: bool | None = None) -> list[Line]:
    return page_lines(body) if (is_page(body) if page is None else page) else plain_lines(body)


# Month names of the five languages, masked in keys.
_MONTH_NAMES = (
    "january february march april may june july august september october november december "
    "januar februar märz april mai juni juli august september oktober november dezember "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
).split()
_WORD = re.compile(r"[^\W\d_]+|\d+|§")


class _Masks(dict):
    """What stands for a word in keys: numbers and months are #."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        out = "#" if word.isdigit() or word in _MONTHS else word
        self[word] = out
        return out


_MONTHS = frozenset(_MONTH_NAMES)
_masks = _Masks()


def site_name(site: str) -> str:
    """The longest label of a host before its top levels: what a site calls itself."""
    labels = site.split(".")
    return max(labels[:-1] or labels, key=len)


def words(text: str, name: str = "") -> list[str]:
    """Lower-case words, numbers and months as #, the site's own name as §."""
    low = text.lower()
    if len(name) > 3:
        low = low.replace(name, "§")
    return [*map(_masks.__getitem__, _WORD.findall(low))]


_CAPITAL = re.compile(r"(?<!^)(?<![.!?:·] )\b[A-ZÀ-Þ][\w'-]*")


def keys(text: str, name: str) -> list[str]:
    """Content keys of a line: its masked words; of a line that names its site, also with other names masked."""
    plain = " ".join(words(text, name))
    if not plain.replace("#", "").strip():
        return []
    out = [plain]
    if "§" in plain and not text.isupper():
        low = re.sub(re.escape(name), "§", text, flags=re.I)
        masked = " ".join("@" if w[0].isupper() else w for w in re.findall(r"[^\W\d_]+|\d+|§", low))
        out.append("n:" + re.sub(r"(?:@ )+@|@", "@", re.sub(r"\d+", "#", masked)))
    return out


_LABEL = re.compile(r"^([^:>»›|/]{3,40}?)\s*[:>»›|]\s*(\S.*)$")
_CREDIT = re.compile(r"^([^\W\d_]+(?: [^\W\d_]+)?):? ([^\W\d_]+ [^\W\d_]+)$")


def label(text: str) -> str:
    """Key of a short line's words before a colon or path mark, or before a person's name; else empty.

    The words before a mark must be more than one and not all capitalised: "Read also: ..." is a label,
    a name before a colon is none. What follows a mark must start like a title and end like one.
    """
    if len(text) > 90 and len(text.split(None, 6)) > 6:
        return ""
    text = " ".join(text.split())
    m = _CREDIT.match(text)
    if m and (m.group(2).istitle() or text.isupper()):
        return "b:" + m.group(1).lower()
    m = _LABEL.match(text)
    if not m or len(text) > 90 or m.group(2)[0].islower() or ends_sentence(text):
        return ""
    head = m.group(1).split()
    if not 2 <= len(head) <= 5 or not (text.isupper() or any(w[0].islower() for w in head)):
        return ""
    return "l:" + " ".join(words(m.group(1)))


HANDLE = re.compile(r"^@?[\w.-]*\d[\w.-]*\s*:\s|^@[\w.-]+\s*:\s")
BULLET = re.compile(r"^\s*(?:[•*·‣–—-]\s+|\d+[.)]\s+)")
SENTENCE_END = re.compile(r"[.!?…][\"'»”’)]*\s*$")


def ends_sentence(text: str) -> bool:
    """What SENTENCE_END finds, without looking through the text."""
    return text.rstrip().rstrip("\"'»”’)")[-1:] in _ENDS


_ENDS = frozenset(".!?…")
