"""Which elements of a page show: a small cascade over style sheets, attributes and element rules.

Of style sheets and style attributes only `display: none` and `visibility` matter.  Selectors may
be made of types, classes, ids and `*`, with descendants and children; parts with anything else
(pseudo-classes, attributes, siblings) don't apply, and neither do media other than screens or
at-rules other than media, so that what isn't understood hides nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))?)?")
# Elements that browsers never show.
HIDDEN = frozenset("head script style template title meta link base noframes noembed iframe object datalist param source track area map audio video canvas desc metadata defs symbol annotation annotation-xml".split())

TOKEN = re.compile(r"\"(?:[^\"\\]|\\.)*+(?:\"|\Z)|'(?:[^'\\]|\\.)*+(?:'|\Z)|\\.|[;{}()\[\]]|[^;{}()\[\]\"'\\]++|\\\Z", re.S)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
MATTERS = re.compile(r"display|visibility", re.I)
SIMPLE = re.compile(r"(\*|[^\s.#*>]+)?((?:[.#][^\s.#*>]+)*)\Z")
SCREENS = frozenset(("", "all", "screen", "only screen", "only all"))


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case with their values; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        if m[1]:
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


Declared = dict[str, tuple[bool, str]]


def declarations(tokens: Iterator[str]) -> Declared:
    """display and visibility of a block's tokens, up to its end: (important, value), the last one counting
    unless an earlier one is important."""
    found: Declared = {}
    part: list[str] = []
    depth = 0

    def end() -> None:
        name, colon, value = "".join(part).partition(":")
        name = name.strip().lower()
        if colon and name in ("display", "visibility"):
            value, mark, _ = value.lower().partition("!")
            new = (bool(mark), value.strip())
            if value.strip() and new[0] >= found.get(name, (False,))[0]:
                found[name] = new
        part.clear()

    for t in tokens:
        if t == ";" and depth <= 0:
            end()
        elif t == "}" and depth <= 0:
            break
        else:
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            part.append(t)
    end()
    return found


class Rule:
    """One selector: its compounds from the right, each (tag or None, ids, classes) with how the next one to the left stands to it."""

    __slots__ = ("declared", "order", "parts", "weight")

    def __init__(self, parts: list, declared: Declared, order: int) -> None:
        self.parts, self.declared, self.order = parts, declared, order
        self.weight = (sum(len(p[1]) for p in parts), sum(len(p[2]) for p in parts), sum(p[0] is not None for p in parts))


def compounds(selector: str) -> list | None:
    """A selector's compounds from the right; None if it has anything else in it."""
    if re.search(r"[:\[\]+~(),|\\&]", selector):
        return None
    parts, child = [], False
    for piece in reversed(re.findall(r">|[^\s>]+", selector)):
        if piece == ">":
            if not parts or child:
                return None
            parts[-1][3] = child = True
            continue
        m = SIMPLE.match(piece)
        if not m:
            return None
        names = re.findall(r"([.#])([^.#]+)", m[2])
        tag = m[1].lower() if m[1] and m[1] != "*" else None
        parts.append([tag, [n for k, n in names if k == "#"], [n for k, n in names if k == "."], False])
        child = False
    return None if not parts or child else parts


def rules_of(sheet: str, order: int = 0) -> list[Rule]:
    """The rules of a style sheet that can change what shows."""
    if not MATTERS.search(sheet):
        return []
    tokens = iter(TOKEN.findall(COMMENT.sub(" ", sheet)))
    rules: list[Rule] = []
    before: list[str] = []
    for t in tokens:
        if t == ";":
            before.clear()
        elif t == "}":  # the end of a media block
            before.clear()
        elif t != "{":
            before.append(t)
        else:
            prelude = "".join(before).strip()
            before.clear()
            if not prelude.startswith("@"):
                declared = declarations(tokens)
                for selector in prelude.split(",") if declared else ():
                    parts = compounds(selector.strip())
                    if parts:
                        rules.append(Rule(parts, declared, order + len(rules)))
            elif not (prelude[:6].lower() == "@media" and any(" ".join(q.split()).lower() in SCREENS for q in prelude[6:].split(","))):
                depth = 1
                for t in tokens:
                    depth += (t == "{") - (t == "}")
                    if not depth:
                        break
    return rules


class Sheet:
    """All rules of a page, found by the id, class or tag of the element that they select."""

    def __init__(self, sheets: list[str]) -> None:
        self.by: dict[str, list[Rule]] = {}
        n = 0
        for sheet in sheets:
            found = rules_of(sheet, n)
            n += len(found)
            for rule in found:
                tag, ids, classes, _ = rule.parts[0]
                self.by.setdefault(f"#{ids[0]}" if ids else f".{classes[0]}" if classes else tag or "*", []).append(rule)

    def declared(self, node, named: dict[str, str]) -> Iterator[Rule]:
        keys = ["*", node.tag, *(f".{c}" for c in named.get("class", "").split())]
        for key in dict.fromkeys([*keys, f"#{named['id']}"] if named.get("id") else keys):
            for rule in self.by.get(key, ()):
                if selects(rule.parts, node, named):
                    yield rule


def fits(part: list, node, named: dict[str, str]) -> bool:
    tag, ids, classes, _ = part
    own = named.get("class", "").split() if classes else ()
    return (tag is None or tag == node.tag) and all(i == named.get("id") for i in ids) and all(c in own for c in classes)


def selects(parts: list, node, named: dict[str, str]) -> bool:
    """Whether the compounds fit the node and elements above it; the nearest that fits is tried first, as
    only a child's place can depend on it."""
    if not fits(parts[0], node, named):
        return False
    open_ = [(1, node)]  # the compound to place, and the element that the one before it took
    tried = set()
    while open_:
        k, below = open_.pop()
        if k == len(parts):
            return True
        up = below.up
        if parts[k - 1][3]:
            if up is not None and fits(parts[k], up, attributes(up.attrs)):
                open_.append((k + 1, up))
            continue
        while up is not None and (k, id(up)) not in tried:
            tried.add((k, id(up)))
            if fits(parts[k], up, attributes(up.attrs)):
                open_.append((k + 1, up))
                if not any(p[3] for p in parts[k:]):
                    break
            up = up.up
    return False


def sheets_of(root) -> list[str]:
    """Texts of the page's style elements for screens, in order."""
    found, todo = [], [iter(root.kids)]
    while todo:
        kid = next(todo[-1], None)
        if kid is None:
            todo.pop()
        elif not isinstance(kid, str):
            if kid.tag == "style":
                if any(" ".join(q.split()).lower() in SCREENS for q in attributes(kid.attrs).get("media", "").split(",")):
                    found.append("".join(x for x in kid.kids if isinstance(x, str)))
            elif kid.kids:
                todo.append(iter(kid.kids))
    return found


def own_style(node, named: dict[str, str], sheet: Sheet | None) -> tuple[str | None, str | None]:
    """The author's display and visibility for the node, if there are any."""
    best: dict[str, tuple] = {}
    for rule in sheet.declared(node, named) if sheet else ():
        for name, (important, value) in rule.declared.items():
            best[name] = max(best.get(name, ((False,),)), ((important, (0, *rule.weight), rule.order), value))
    style = named.get("style", "")
    if style and MATTERS.search(style):
        for name, (important, value) in declarations(iter(TOKEN.findall(COMMENT.sub(" ", style)))).items():
            best[name] = max(best.get(name, ((False,),)), ((important, (1,), 0), value))
    return tuple(best[n][1] if n in best else None for n in ("display", "visibility"))


def chosen_options(select, named: dict[str, str]) -> list | None:
    """The option that a closed list shows; None if the list is open, and shows all."""
    size = named.get("size", "").strip()
    if "multiple" in named or size.isdigit() and int(size) > 1:
        return None
    options, todo = [], [iter(select.kids)]
    while todo:
        kid = next(todo[-1], None)
        if kid is None:
            todo.pop()
        elif not isinstance(kid, str):
            if kid.tag == "option":
                options.append(kid)
            else:
                todo.append(iter(kid.kids))
    marked = [x for x in options if "selected" in attributes(x.attrs)]
    return marked[-1:] or options[:1]


def prune(root) -> None:
    """Take out of the tree what doesn't show: elements that aren't displayed, and the texts of elements
    that are displayed but not visible.  Elements inside those may be visible again."""
    sheets = sheets_of(root)
    sheet = Sheet(sheets) if any(map(MATTERS.search, sheets)) else None
    todo = [(root, True)]
    while todo:
        node, seen = todo.pop()
        kids = node.kids
        if node.tag == "details" and "open" not in attributes(node.attrs):
            kids = next(([k] for k in kids if not isinstance(k, str) and k.tag == "summary"), [])
        elif node.tag == "select":
            only = chosen_options(node, attributes(node.attrs))
            kids = kids if only is None else only
        left = []
        for kid in kids:
            if isinstance(kid, str):
                if seen:
                    left.append(kid)
                continue
            if kid.tag in HIDDEN:
                continue
            kid.up = node
            named = attributes(kid.attrs) if kid.attrs else {}
            display, visibility = own_style(kid, named, sheet) if sheet or "style" in named else (None, None)
            if display is None and (named.get("hidden", "until-found").strip().lower() != "until-found" or kid.tag == "dialog" and "open" not in named):
                display = "none"
            if display != "none":
                left.append(kid)
                todo.append((kid, seen if visibility in (None, "inherit", "unset") else visibility not in ("hidden", "collapse")))
        node.kids = left
