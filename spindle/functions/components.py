"""What is read off a component's code: styles, interactions, texts, classes, references, props, icons, its type."""

from __future__ import annotations

import hashlib
import re

from spindle.functions import lexer

# How many of each are kept.
MOST_STYLES, MOST_INTERACTIONS, MOST_TEXTS, MOST_CLASSES, MOST_PROPS, SNIPPET = 40, 15, 30, 10, 30, 8_000
PADDED, MOST_PADDED = 16, 8
# Names that are no components.
INTERNALS = frozenset(
    "Fragment Suspense StrictMode Provider Router Switch Route Redirect ErrorBoundary Component PureComponent React useState useEffect useRef useCallback useMemo "
    "useContext useReducer createContext forwardRef memo ReactDOM FiberNode FiberRootNode SyntheticBaseEvent ChildReconciler Generator AsyncGenerator ReactDOMRoot ReactDOMHydrationRoot".split()
)
# Values that say nothing.
BLANK = frozenset(("", "true", "false", "null", "undefined", "inherit"))
# Patterns of component code.
TAG = re.compile(r"<(?:[A-Za-z_$][\w$]*\.)*([A-Z][a-zA-Z0-9]{2,})[\s/>]")
CALL = re.compile(r"jsxs?\(([A-Z][a-zA-Z0-9]{2,})\s*,")
SUFFIXED = re.compile(
    r"\b([A-Z][a-zA-Z0-9]{2,}(?:Card|Modal|Row|Tab|Panel|Form|Head|List|Table|Btn|Button|Badge|Item|Section|Chart|Detail|View|Drawer|Widget|Dot|Pill|Select|Input|Toggle|Switch|Avatar|Icon|Spinner|Toast|Alert|Banner))\b"
)
MARKER = re.compile(r"\[\s*(?:conditional|list|either)\s*:\s*([A-Z][A-Za-z0-9]*(?:\|[A-Z][A-Za-z0-9]*)*)\s*\]")
MUTATION = re.compile(r"style\.(\w+)\s*=\s*([^;}]{1,80})")
TRANSITION = re.compile(r"""transition["']?\s*:\s*["']?([^,"'}\n]{5,60})""")
STATE = re.compile(r"const\s*\[\s*(\w+)\s*,\s*(set\w+)\s*\]\s*=\s*useState\(\s*(?:true|false)\s*\)")
CLASS = re.compile(r"""className\s*[=:]\s*["']([^"']{2,120})["']""")
TEXTS = (
    ("heading", re.compile(r"""<h[1-6][^>]*>\s*["']?([^<"']{3,60})""")),
    ("button_label", re.compile(r"""<(?:button|Btn)[\s\S]*?>\s*\n?\s*([A-ZÁÉÍÓÚÀÂÊÎÔÛÃÕÇ][^<"']{1,39})""")),
    ("label", re.compile(r"""<(?:label|span)[^>]*>\s*["']?([^<"']{3,60})""")),
    ("placeholder", re.compile(r"""placeholder[=:]\s*["']([^"']{3,60})["']""")),
    ("tooltip", re.compile(r"""(?:title|aria-label|alt)\s*=\s*["']([^"']{3,80})["']""")),
    ("", re.compile(r"""["']([A-ZÁÉÍÓÚÀÂÊÎÔÛÃÕÇ][^"']{2,80})["']""")),
)
ALIAS = re.compile(r"\bconst\s+([A-Z][a-zA-Z0-9]{2,})\s*=\s*[a-zA-Z_$][\w$]*(?:\.[a-zA-Z_$][\w$]*)*\.([A-Z][a-zA-Z0-9]{2,})\s*;")
SECTION_COMMENT = re.compile(r"\{/\*\s*[─━\-=*]{0,6}\s*(.{2,300}?)\s*[─━\-=*]{0,6}\s*\*/\}")
# Endings of screens by kind, and how forms to sign in begin.
SCREEN_ENDINGS = (("Page", "Screen", "Dashboard"), ("View",), ("Detail",))
SIGN_IN = ("Login", "SignIn", "SignUp", "Register", "Auth")
#: Tabs that a component shows by turns if it is a screen, whatever its name.
TABS = 2
# Words of names and the types that they tell, the last word of a name first.
TYPES = (
    ("modal", "Modal Dialog Confirm Overlay"), ("drawer", "Drawer"), ("card", "Card"), ("button", "Btn Button"), ("badge", "Badge Tag Pill Chip"), ("row", "Row"),
    ("table", "Table Grid"), ("form", "Form"), ("input", "Input Field Select"), ("tab", "Tab Tabs"), ("nav", "Nav Sidebar Topbar Header Menu"), ("list", "List"),
    ("chart", "Chart Sparkline"), ("panel", "Panel"), ("toggle", "Toggle Switch"), ("avatar", "Avatar"), ("icon", "Icon"), ("section", "Section"),
)


def entity_id(prefix: str, seed: str) -> str:
    return f"{prefix}_{hashlib.md5(seed.encode('utf-8', 'surrogatepass')).hexdigest()[:8]}"


def component_type(name: str) -> str:
    for word in reversed(re.findall(r"[A-Z][a-z0-9]*|[A-Z]+(?![a-z])", name)):
        for kind, words in TYPES:
            if word in words.split():
                return kind
    return "component"


def is_screen(name: str, code: str = "") -> bool:
    """By its name, or as it shows two tabs or more on conditions."""
    named = any(name.endswith(kind) and len(name) > min(map(len, kind)) for kind in SCREEN_ENDINGS)
    form = name.endswith("Form") and name.startswith(SIGN_IN)
    tabs = re.findall(r"\[conditional:[A-Za-z0-9]*Tab\]", sanitized(code)) if code.count("Tab") >= TABS else ()
    return named or form or len(tabs) >= TABS


def plausible(text: str) -> bool:
    """Words to be read, not a name or a colour."""
    text = text.strip()
    return 3 <= len(text) <= 80 and not re.fullmatch("[a-z_]+", text) and not text.startswith(("#", "rgba"))


def first_of_each(rows: list[dict], most: int | None = None) -> list[dict]:
    return list({r["id"]: r for r in reversed(rows)}.values())[::-1][:most]


def constant_bodies(source: str) -> dict[str, str]:
    """The insides of all `const name = {...}`."""
    found = {}
    for m in re.finditer(r"\bconst\s+(\w+)\s*=\s*\{", source):
        end = lexer.closing(source, m.end() - 1)
        if end is not None:
            found.setdefault(m[1], source[m.end() : end - 1])
    return found


def palette(source: str) -> dict[str, str]:
    """name.key -> colour of the constant that is mostly colours, the one with the most of them."""
    best: dict[str, str] = {}
    for name, body in constant_bodies(source).items():
        entries = lexer.pairs(body)
        colours = {f"{name}.{k}": v.lower() for k, v in entries if re.fullmatch("#[0-9a-fA-F]{3,8}", v)}
        if len(colours) >= 4 and len(colours) >= 0.6 * len(entries) and len(colours) > len(best):
            best = colours
    return best


def styles(name: str, code: str, constants: dict[str, str], colours: dict[str, str]) -> list[dict]:
    """Inline styles; what a literal spreads is read before its own properties, which win."""
    rows: list[dict] = []
    for literal in lexer.style_literals(code):
        if len(rows) >= MOST_STYLES:
            break
        merged: dict[str, str] = {}
        for spread in re.findall(r"\.\.\.(\w+)", literal):
            merged |= dict(lexer.pairs(constants.get(spread, "")))
        merged |= dict(lexer.pairs(literal))
        rows += [style(name, "default", p, colours.get(v, v)) for p, v in merged.items() if v not in BLANK]
    return first_of_each(rows)


def style(element: str, state: str, prop: str, value: str) -> dict:
    seed = f"{element}_{prop}_{value}" if state == "default" else f"{element}_{state}_{prop}_{value}"
    return {"id": entity_id("st", seed), "element": element, "state": state, "property": prop, "value": value}


def mutations(code: str, event: str) -> list[tuple[str, str]]:
    return [(p, lexer.unquoted(v.strip().rstrip(")").strip())) for body in lexer.handler_bodies(code, event) for p, v in MUTATION.findall(body)]


def interactions(name: str, code: str) -> tuple[list[dict], list[dict]]:
    """(interactions, styles of states): what handlers set, entering paired with leaving by place, and what a state toggles."""
    m = TRANSITION.search(code)
    transition = m[1].strip() if m else "all 0.15s"
    rows, states = [], []
    for (prop, value), (_, before) in zip(mutations(code, "onMouseEnter"), mutations(code, "onMouseLeave"), strict=False):
        rows.append({"id": entity_id("int", f"{name}_{prop}_{value}"), "trigger": "hover", "css_prop": prop, "from_val": before, "to_val": value, "transition": transition})
        states.append(style(name, "hover", prop, value))
    for prop, value in mutations(code, "onFocus"):
        rows.append({"id": entity_id("int", f"{name}_focus_{prop}"), "trigger": "focus", "css_prop": prop, "from_val": "", "to_val": value, "transition": transition})
    for state, setter in STATE.findall(code):
        sets = [event for event in ("onMouseEnter", "onMouseLeave", "onFocus") if re.search(rf"\b{event}\b[^}}]{{0,40}}\b{setter}\((?:true|false)\)", code)]
        trigger = "hover" if {"onMouseEnter", "onMouseLeave"} <= set(sets) else "focus" if "onFocus" in sets else None
        for prop, then, other in re.findall(rf"(\w+)\s*:\s*[^,}}]*?\b{state}\s*\?\s*([^:?]{{1,80}})\s*:\s*([^,;\n}}]{{1,80}})", code) if trigger else ():
            value, before = (lexer.unquoted(x.strip(" `}").strip()) for x in (then, other))
            rows.append({"id": entity_id("int", f"{name}_{prop}_{value}"), "trigger": trigger, "css_prop": prop, "from_val": before, "to_val": value, "transition": transition})
            states.append(style(name, trigger, prop, value))
    return first_of_each(rows, MOST_INTERACTIONS), states


def texts(name: str, code: str) -> list[dict]:
    """Words to be read, by where they stand; of one text the first kind counts."""
    rows = []
    for kind, pattern in TEXTS:
        for found in pattern.findall(code):
            content = found.strip()
            if plausible(content):
                rows.append({"id": entity_id("txt", f"{name}_{content}"), "content": content, "text_type": kind or ("description" if len(content) > 40 else "label"), "source": name, "element": ""})
    return first_of_each(rows, MOST_TEXTS)


def references(name: str, code: str) -> list[str]:
    marked = {x for m in MARKER.findall(code) for x in m.split("|")}
    found = {*TAG.findall(code), *CALL.findall(code), *SUFFIXED.findall(code), *marked}
    return sorted(found - INTERNALS - {name})


def props(name: str, code: str) -> list[dict]:
    """Names and defaults of the parameters that a component takes apart."""
    m = re.match(r"(?:function\s+\w+|const\s+\w+\s*=)\s*\(\s*\{", code[:600])
    end = lexer.closing(code, m.end() - 1) if m else None
    rows = []
    for part in lexer.split(code[m.end() : end - 1]) if end else ():
        key, _, default = part.strip().partition("=")
        key = key.partition(":")[0].strip()
        if re.fullmatch(r"[a-z_]\w*", key):
            rows.append({"id": entity_id("prop", f"{name}_{key}"), "component_name": name, "prop_name": key, "default_value": lexer.unquoted(default.strip())})
    return first_of_each(rows, MOST_PROPS)


def icons(markup: str) -> tuple[str, list[dict]]:
    """The markup with its outermost pictures replaced by markers, and the pictures."""
    found, out, at = [], [], 0
    tags = list(re.finditer(r"<svg\b[^>]*?(/)?>|</svg\s*>", markup, re.IGNORECASE))
    depth = start = 0
    for m in tags:
        closes = m[0].startswith("</")
        if not closes and depth == 0:
            start = m.start()
        if not closes and not m[1]:
            depth += 1
            continue
        depth -= closes and depth > 0
        if depth == 0 and start >= at:
            picture = markup[start : m.end()]
            found.append({"id": entity_id("icon", picture), "markup": picture})
            out += [markup[at:start], f"{{[icon:{found[-1]['id']}]}}"]
            at, start = m.end(), len(markup)
    return "".join([*out, markup[at:]]), first_of_each(found)


def sanitized(markup: str) -> str:
    """Markup with long handlers shortened, and lists, conditions and choices of components replaced by markers."""
    heads = (
        ("list", re.compile(r"\{[^{}<>]{0,80}\.map\([^)]{0,120}\s*=>\s*(?:\([^)]*\)|\s*)?<([A-Z][A-Za-z0-9]+)")),
        ("conditional", re.compile(r"\{[^{}<>&]{1,120}&{2}\s*<([A-Z][A-Za-z0-9]+)")),
        ("either", re.compile(r"\{[^{}<>?]{1,120}\?\s*<([A-Z][A-Za-z0-9]+)")),
    )
    markup = re.sub(r"(on[A-Z]\w+)\s*=\s*\{(?:[^{}]|\{[^{}]*\}){60,}\}", r"\1={...}", markup)
    for kind, head in heads:
        at, out = 0, []
        while m := head.search(markup, at):
            end = lexer.closing(markup, m.start())
            if end is None:
                out.append(markup[at : m.end()])
                at = m.end()
                continue
            other = re.search(r":\s*<([A-Z][A-Za-z0-9]+)", markup[m.end() : end]) if kind == "either" else None
            out += [markup[at : m.start()], f"{{[{kind}:{m[1]}{'|' + other[1] if other else ''}]}}"]
            at = end
        markup = "".join([*out, markup[at:]])
    return markup


def padded_parts(markup: str) -> list[tuple[str, str, str]]:
    """Parts of markup without section comments: widely padded divisions that don't overlap the one before, the first ones."""
    parts, end = [], None
    for m in re.finditer(r"""style=\{\{[^}]*(?:padding|margin)\s*:\s*["']?(\d+)px""", markup):
        start = markup.rfind("<div", 0, m.start())
        if int(m[1]) < PADDED or start < 0 or (end is not None and start <= end - 200):
            continue
        closed = markup.find("</div>", m.start())
        end = closed + len("</div>") if closed >= 0 else m.start() + 4_000
        part = markup[start:end]
        label = next((x.strip() for x in TEXTS[-1][1].findall(part) if len(x.strip()) > 3), f"Section{len(parts) + 1}")
        parts.append((label, part, "structural"))
    return parts[:MOST_PADDED]


def sections(screen: str, markup: str) -> list[dict]:
    """Parts of a screen between its section comments; those with a reference, two texts or three styles."""
    marks = list(SECTION_COMMENT.finditer(markup))
    parts = [(m[1].split(":")[0].strip()[:60].rstrip(), markup[m.end() : after.start() if after else m.end() + 4_000], "comment") for m, after in zip(marks, [*marks[1:], None], strict=False)]
    rows = []
    for label, part, how in parts or padded_parts(markup):
        own = {p: v for literal in lexer.style_literals(part) for p, v in lexer.pairs(literal) if v not in BLANK}
        words = list(dict.fromkeys(t["content"] for t in texts(screen, part)))
        refs = references(screen, part)
        if refs or len(words) >= 2 or len(own) >= 3:
            rows.append({"id": entity_id("sec", f"{screen}_{label}"), "screen": screen, "name": label, "styles": list(own.items()), "components": refs, "texts": words, "jsx_snippet": part.strip()[:SNIPPET], "detection_method": how})
    return first_of_each(rows)


# What kind of text a key of a constant holds.
TEXT_KEYS = {"title": "heading", "heading": "heading", "description": "description", "subtitle": "description", "hint": "description", "placeholder": "placeholder"}


def constant_texts(js: str, declared: list[lexer.Function]) -> list[dict]:
    """Words to be read in constant arrays of objects outside all functions."""
    rows = []
    for m in re.finditer(r"\bconst\s+([A-Z][A-Z0-9_]*)\s*=\s*\[", js):
        end = lexer.closing(js, m.end() - 1)
        if end is None or any(f.start <= m.start() < f.end for f in declared):
            continue
        for element in (x.strip() for x in lexer.split(js[m.end() : end - 1])):
            for part in lexer.split(element[1:-1]) if element[:1] == "{" and element[-1:] == "}" else ():
                key, _, value = (x.strip() for x in part.partition(":"))
                content = lexer.unquoted(value).strip()
                if content != value and plausible(content):
                    rows.append({"id": entity_id("txt", f"{m[1]}_{content}"), "content": content, "text_type": TEXT_KEYS.get(key, "label"), "source": m[1], "element": ""})
    return first_of_each(rows)


def component(name: str, code: str, constants: dict[str, str], colours: dict[str, str]) -> dict:
    """Everything about one declared component."""
    markup, pictures = icons(lexer.returned(code))
    acted, states = interactions(name, code)
    return {
        "name": name,
        "comp_type": component_type(name),
        "screen": is_screen(name, code),
        "jsx_snippet": sanitized(markup)[:SNIPPET],
        "classes": " ".join(list(dict.fromkeys(c for found in CLASS.findall(code) for c in found.split()))[:MOST_CLASSES]),
        "styles": first_of_each([*styles(name, code, constants, colours), *states]),
        "interactions": acted,
        "texts": texts(name, code),
        "refs": references(name, code),
        "props": props(name, code),
        "icons": pictures,
        "tags": sorted(set(re.findall(r"<([a-z][a-z0-9]*)\b", code))),
        "sections": sections(name, markup) if is_screen(name, code) else [],
    }


def components(js: str) -> list[dict]:
    """All declared components that return markup, in their order; references by an alias name what it stands for."""
    constants, colours = constant_bodies(js), palette(js)
    found = [component(f.name, js[f.start : f.end], constants, colours) | {"place": i} for i, f in enumerate(lexer.functions(js)) if lexer.returns_markup(js[f.start : f.end])]
    known = {c["name"] for c in found}
    aliases = {a: b for a, b in ALIAS.findall(js) if b in known}
    for c in found:
        c["refs"] = sorted({aliases.get(r, r) for r in c["refs"]} - {c["name"]})
    return found
