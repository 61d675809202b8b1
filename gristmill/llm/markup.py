"""Problem 5: markup in text documents, parsed to a tree, scored, and written again as clean text."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.arrow import map_rows
from gristmill.session import one_per_key

# fixed values: element names, grouped by what they do to the text
BLOCK_TAGS = set("html body main article section div p blockquote header footer nav aside form fieldset figure figcaption address details summary center dl dt dd ul ol menu li table thead tbody tfoot tr td th caption colgroup col hr br pre h1 h2 h3 h4 h5 h6 head title script style iframe template svg".split())
INLINE_TAGS = set("a abbr acronym b big bdi bdo cite code data del dfn em embed font i img input ins kbd label link mark meta nobr option picture q rp rt ruby s samp small source span strike strong sub sup time tt u var video audio wbr canvas map area param track output progress meter base noscript object select textarea button".split())
DROPPED_TAGS = {"script", "style", "iframe", "template", "svg", "head"}
VOID_TAGS = set("br hr img input link meta area base col embed param source track wbr".split())
# fixed values: LaTeX commands known without an argument in braces, and what they read as
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "sim": "∼", "equiv": "≡", "times": "×", "cdot": "·", "div": "÷", "pm": "±", "mp": "∓", "infty": "∞", "partial": "∂", "nabla": "∇", "sum": "∑", "prod": "∏", "int": "∫", "in": "∈", "notin": "∉", "subset": "⊂", "subseteq": "⊆", "cup": "∪", "cap": "∩", "emptyset": "∅", "forall": "∀", "exists": "∃", "neg": "¬", "land": "∧", "lor": "∨",
    "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftarrow": "⇐", "mapsto": "↦", "ldots": "…", "dots": "…", "cdots": "⋯", "quad": " ", "qquad": " ", "log": "log", "ln": "ln", "exp": "exp", "sin": "sin", "cos": "cos", "tan": "tan", "max": "max", "min": "min", "lim": "lim", "arg": "arg", "det": "det",
    "item": "", "hline": "", "toprule": "", "midrule": "", "bottomrule": "", "centering": "", "noindent": "", "newline": " ", "newpage": "", "clearpage": "", "maketitle": "", "tableofcontents": "", "par": "", "bfseries": "", "itshape": "", "small": "", "large": "", "textbackslash": "\\", "LaTeX": "LaTeX", "TeX": "TeX", "left": "", "right": "", "displaystyle": "", "medskip": "", "bigskip": "", "smallskip": "", "hfill": "", "appendix": "",
}
SILENT = set("label ref eqref pageref cite citep citet index vspace hspace includegraphics usepackage documentclass bibliography bibliographystyle input include pagestyle thispagestyle setlength setcounter".split())
HEADING_COMMANDS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
CODE_ENVIRONMENTS = {"verbatim", "lstlisting", "minted", "alltt", "Verbatim"}
THINNED = 64  # ancestors a paragraph gives points to; the share of the next would be under a hundredth of a point
FORMULA_ENVIRONMENTS = {"equation", "align", "displaymath", "math", "gather", "multline", "eqnarray", "alignat"}

_TAG = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[^<>]*)?/?)>", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_FENCE = re.compile(r"^\s{0,12}(`{3,}|~{3,})[ \t]*([\w+.#-]*)[ \t]*$")
_HASH = re.compile(r"^\s{0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
_EQUALS = re.compile(r"^\s*(={2,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
_UNDERLINE = re.compile(r"^\s{0,3}(=+|-+)[ \t]*$")
_RULE_ROW = re.compile(r"^\s*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_BULLET = re.compile(r"^(\s*)([-+*•‣◦]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])[ \t]+(.*)$")
_TASK = re.compile(r"^\[[ xX]\][ \t]+")
_NUMBERED = re.compile(r"^\s*\d{1,2}(?:\.\d{1,3}){0,4}\.?[ \t]+[A-ZÀ-Þ][^.!?;:]{2,100}$")
_UPPER = re.compile(r"^\s*[A-ZÀ-Þ][A-ZÀ-Þ0-9 ,&/()'’-]{3,100}:\s*$")
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")
_COMMAND = re.compile(r"\\([A-Za-z]+)(\*?)")
_DISPLAY = re.compile(r"\\\[(.+?)\\\]|(?<![\\$])\$\$(.+?)\$\$", re.S)
_MATH = re.compile(r"\\\((.+?)\\\)|(?<![\\$\w])\$(?![\s$])((?:[^$\n\\]|\\.)+?)(?<!\s)\$(?![\d$])")
_MATHLIKE = re.compile(r"[\\^={}]|_[{\w]|^[A-Za-z]'?$|[A-Za-z]\s*[<>+*/-]\s*\w|^[A-Za-z]\w{0,2}\([^)]*\)$")
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:<[^<>\n]*>|[^()\s]+(?:\([^()\s]*\)[^()\s]*)*)?(?:\s+[\"'(][^\n]*?[\"')])?\)")
_REFERENCE = re.compile(r"!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]")
_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^\n]+?)(?<!`)\1(?!`)")
_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])(.+?)(?<=[^\s~])~~(?!~)")
_EMPHASIS = re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]*?[^\s*])\1(?![\w*])|(?<![\w\\])(_{1,3})(?=[^\s_])([^\n]*?[^\s_])\3(?![\w])")
_WIKI_LINK = re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
_QUOTES = re.compile(r"(?<![\w'])('{2,5})(?=[^\s'])([^\n]*?[^\s'])\1(?!['\w])")
_TEMPLATE = re.compile(r"\{\{([^{}|\n]+?)(\|[^{}]*)?\}\}", re.S)
_ESCAPE = re.compile(r"(?<![\w:\\/])\\([%&$#_{}])")
_LOGO = re.compile(r"\x02([^\x02\x03]*)\x03")
_CANDIDATE = re.compile(r"[<&#*_`~\[\]{}\\$|]|''|^\s*[=-]{2,}|==", re.M)


@dataclass
class Block:
    """A leaf: heading, para, item, code, formula or row."""

    kind: str
    text: str
    level: int = 0
    linked: int = 0  # characters of links
    kinds: frozenset = frozenset()  # of the markup it was written in

    @property
    def density(self) -> float:
        return min(1.0, self.linked / max(1, len(self.text)))


@dataclass
class Node:
    tag: str
    children: list = field(default_factory=list)
    score: float = 0.0
    kinds: set = field(default_factory=set)
    chars: int = 0  # of all blocks below
    linked: int = 0
    plain: bool = True  # no code and no formula below


class Parser:
    """Reads a text into a tree and notes each kind of markup it meets."""

    def __init__(self, text: str):
        self.kinds: set[str] = set()  # met since the last block; the next one carries them
        self.headed = False
        self.root = Node("root")
        self._elements(text)
        self.root.kinds |= self.kinds

    def _put(self, node: Node, block: Block) -> None:
        block.kinds = frozenset(self.kinds)
        self.kinds.clear()
        node.children.append(block)

    # ---- elements

    def _elements(self, text: str) -> None:
        stack, run, at = [self.root], [], 0
        opened: Counter[str] = Counter()
        heading = item = row = 0
        ordered: list[int] = []

        def close_run(kind: str = "", level: int = 0) -> None:
            joined = "".join(run)
            run.clear()
            if not joined.strip(" \t\n\x02\x03"):
                return
            if kind:
                self._leaf(stack[-1], kind, joined, level)
            else:
                self._lines(stack[-1], joined)

        end = len(text)
        tags = list(self._outside_code(_TAG.finditer(text), text)) if "<" in text else []
        ends = self._element_ends(tags, text)
        for m in tags:
            name = (m[2] or "").lower()
            if name and name not in BLOCK_TAGS and name not in INLINE_TAGS:
                continue  # a placeholder or a comparison
            if name and not self._is_tag(m, name):
                continue
            if m.start() < at:
                continue
            self.kinds.add("html")
            run.append(text[at : m.start()])
            at = m.end()
            if not name:
                continue
            closing = bool(m[1])
            if name == "a":
                run.append("\x03" if closing else "\x02")
            elif name == "img":
                alt = re.search(r"alt\s*=\s*[\"']([^\"']*)", m[3] or "")
                run.append(alt[1] if alt else "")
            elif name == "option":
                run.append("\n")
            elif name in INLINE_TAGS:
                pass
            elif name in DROPPED_TAGS and not closing:
                at = ends.get(m.start(), at)  # without an end of its own only the tag goes
            elif name == "pre" and not closing:
                close_run()
                stop = re.compile(r"</pre\s*>", re.I).search(text, at)
                body = text[at : stop.start() if stop else end]
                body = re.sub(r"</?(?:code|span|b|i|em|strong|samp|kbd)\b[^<>]*>", "", body)
                self._put(stack[-1], Block("code", self._entities(body).strip("\n")))
                at = stop.end() if stop else end
            elif name == "br":
                run.append("\n")
            elif name == "hr":
                close_run()
            elif re.fullmatch(r"h[1-6]", name):
                close_run("heading" if closing and heading else "", heading)
                heading = 0 if closing else int(name[1])
            elif name == "li":
                close_run("item" if item else "", item)
                if not closing and ordered and ordered[-1] >= 0:
                    ordered[-1] += 1
                item = 0 if closing else (ordered[-1] if ordered and ordered[-1] > 0 else -1)
            elif name in ("td", "th"):
                if not closing and row:
                    run.append("\t")
                row = row or 1
            elif name == "tr":
                close_run("row" if row else "")
                row = 0
            else:
                close_run("item" if item and name in ("ul", "ol") else "heading" if heading else "", item if item else heading)
                if name in ("ul", "ol"):
                    ordered.append(0 if name == "ol" else -1) if not closing else ordered and ordered.pop()
                    item = 0
                if closing:
                    while opened[name]:
                        last = stack.pop().tag
                        opened[last] -= 1
                        if last == name:
                            break
                elif name not in VOID_TAGS:
                    if name == "p" and stack[-1].tag == "p":
                        opened[stack.pop().tag] -= 1
                    node = Node(name, kinds={"html"})
                    stack[-1].children.append(node)
                    stack.append(node)
                    opened[name] += 1
        run.append(text[at:])
        close_run("heading" if heading else "item" if item else "row" if row else "", heading or item)

    @staticmethod
    def _is_tag(m: re.Match, name: str) -> bool:
        """Attributes look like attributes; a bare closing or opening tag of a known name is one."""
        rest = (m[3] or "").strip().rstrip("/").strip()
        return not rest or "=" in rest or re.fullmatch(r"(?:disabled|checked|hidden|required|readonly|nowrap|open|async|defer|selected|reversed|controls)(?:\s+\w+)*", rest, re.I) is not None

    @classmethod
    def _element_ends(cls, tags: list[re.Match], text: str) -> dict[int, int]:
        """Where each dropped element ends, by its start. Self-closed tags, those never closed and those quoted within a script have no end."""
        opened: dict[str, list[int]] = {}
        ends: dict[int, int] = {}
        for m in tags:
            name = (m[2] or "").lower()
            if name not in DROPPED_TAGS or not cls._is_tag(m, name):
                continue
            starts = opened.setdefault(name, [])
            if m[1]:
                if starts:
                    ends[starts.pop()] = m.end()
            elif not m[3].endswith("/") and not (starts and text[m.start() - 1] in "\"'`"):
                starts.append(m.start())
        return ends

    @staticmethod
    def _outside_code(tags, text: str):
        """Tags that do not stand in fenced code."""
        spans, start = [], None
        if "```" in text or "~~~" in text:
            for m in re.finditer(r"^\s{0,12}(?:`{3,}|~{3,})[ \t]*[\w+.#-]*[ \t]*$", text, re.M):
                if start is None:
                    start = m.start()
                else:
                    spans.append((start, m.end()))
                    start = None
        begins = [a for a, _ in spans]
        for m in tags:
            at = bisect_right(begins, m.start()) - 1
            if at < 0 or m.start() >= spans[at][1]:
                yield m

    # ---- lines

    def _leaf(self, node: Node, kind: str, raw: str, level: int) -> None:
        if kind == "row":
            cells = [self._inline(c) for c in raw.split("\t")]
            self._put(node, Block("row", "  ".join(c.strip() for c in cells if c.strip())))
            return
        self._add(node, kind, " ".join(raw.split()) if kind == "heading" else raw.strip(), level)

    def _add(self, node: Node, kind: str, raw: str, level: int = 0) -> None:
        text = self._inline(raw)
        linked = sum(len(x) for x in _LOGO.findall(text))
        text = text.replace("\x02", "").replace("\x03", "").strip()
        if kind == "heading":
            self.headed = True
        if text:
            self._put(node, Block(kind, text, level, linked))

    def _lines(self, node: Node, run: str) -> None:
        lines, i, para = run.split("\n"), 0, []

        def flush() -> None:
            if para:
                self._add(node, "para", "\n".join(para))
                para.clear()

        while i < len(lines):
            line = lines[i]
            bare = line.strip()
            following = lines[i + 1] if i + 1 < len(lines) else ""
            if not bare:
                flush()
                i += 1
                continue
            if m := _FENCE.match(line):
                self.kinds.add("markdown")
                flush()
                close = next((j for j in range(i + 1, len(lines)) if (f := _FENCE.match(lines[j])) and f[1][0] == m[1][0] and len(f[1]) >= len(m[1]) and not f[2]), len(lines))
                self._put(node, Block("code", "\n".join(lines[i + 1 : close])))
                i = close + 1
                continue
            if "\\begin{" in line and (m := _ENVIRONMENT.search(line)) and m[1] == "begin":
                name = m[2].rstrip("*")
                if name in CODE_ENVIRONMENTS | FORMULA_ENVIRONMENTS:
                    self.kinds.add("latex")
                    if line[: m.start()].strip():
                        para.append(line[: m.start()])
                    flush()
                    body = [re.sub(r"^(?:\[[^\]]*\]|\{[^}]*\})+", "", line[m.end() :])]
                    j = i + 1
                    while f"\\end{{{m[2]}}}" not in body[-1] and j < len(lines):
                        body.append(lines[j])
                        j += 1
                    last, _, tail = body[-1].partition(f"\\end{{{m[2]}}}")
                    content = "\n".join([*body[:-1], last]).strip("\n")
                    self._put(node, Block("code", content) if name in CODE_ENVIRONMENTS else Block("formula", formula(content)))
                    lines[j - 1 : j] = [tail] if tail.strip() else [""]
                    i = j - 1
                    continue
            if bare.startswith("{|"):
                close = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith("|}")), None)
                if close is not None or any(x.strip().startswith("|-") for x in lines[i + 1 : i + 4]):
                    self.kinds.add("wiki")
                    flush()
                    self._wiki_rows(node, lines[i + 1 : close if close is not None else len(lines)])
                    i = (close if close is not None else len(lines)) + 1
                    continue
            if bare == "|}" or bare == "|-":  # a brace table whose beginning was cut off
                self.kinds.add("wiki")
                flush()
                i += 1
                continue
            if bare.startswith("{{") and "}}" not in bare and (m := re.match(r"\{\{\s*([\w -]+)\|?", bare)):
                close = next((j for j in range(i + 1, len(lines)) if "}}" in lines[j]), None)
                if close is not None:
                    self.kinds.add("wiki")
                    flush()
                    body = [bare[m.end() :], *lines[i + 1 : close], lines[close].partition("}}")[0]]
                    self._put(node, Block("code", "\n".join(x for x in body if x.strip())))
                    i = close + 1
                    continue
            if bare == "}}":
                self.kinds.add("wiki")
                flush()
                i += 1
                continue
            if m := _HASH.match(line):
                self.kinds.add("markdown")
                flush()
                self._add(node, "heading", m[2], len(m[1]))
                i += 1
                continue
            if m := _EQUALS.match(line):
                self.kinds.add("wiki")
                flush()
                self._add(node, "heading", m[2], len(m[1]))
                i += 1
                continue
            if "|" in line and "|" in following and "-" in following and _RULE_ROW.match(following):
                self.kinds.add("markdown")
                flush()
                self._row(node, bare)
                i += 2
                while i < len(lines) and "|" in lines[i] and lines[i].strip():
                    self._row(node, lines[i].strip())
                    i += 1
                continue
            if (m := _UNDERLINE.match(following)) and len(m[1]) >= 3 and not _BULLET.match(line) and not _UNDERLINE.match(line) and "|" not in line:
                self.kinds.add("markdown")
                flush()
                self._add(node, "heading", bare, 1 if m[1][0] == "=" else 2)
                i += 2
                continue
            if m := re.match(r"^\s*\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{", line):
                title, rest = _braced(line, m.end() - 1)
                self.kinds.add("latex")
                flush()
                self._add(node, "heading", title, HEADING_COMMANDS[m[1]])
                if rest.strip():
                    lines[i] = rest
                    continue
                i += 1
                continue
            if m := re.match(r"^\s*\\item\b(?:\[([^\]]*)\])?\s*", line):
                self.kinds.add("latex")
                flush()
                self._add(node, "item", ((m[1] + " ") if m[1] else "") + line[m.end() :], -1)
                i += 1
                continue
            if _ENVIRONMENT.fullmatch(re.sub(r"(\{[A-Za-z]+\*?\})(?:\[[^\]]*\]|\{[^}]*\})*$", r"\1", bare)):
                self.kinds.add("latex")
                flush()
                i += 1
                continue
            if bare.endswith("\\\\") and " & " in bare:
                self.kinds.add("latex")
                flush()
                self._put(node, Block("row", "  ".join(self._inline(c).strip() for c in bare[:-2].split("&"))))
                i += 1
                continue
            if bare.startswith("|") and "||" in bare and not bare.endswith("|"):  # a row of a brace table that was cut
                self.kinds.add("wiki")
                flush()
                self._wiki_rows(node, [bare])
                i += 1
                continue
            if _NUMBERED.match(line) or _UPPER.match(line):
                if not para and not following.strip():
                    self.headed = True
            if m := _BULLET.match(line):
                flush()
                body, mark = m[3], m[2]
                if t := _TASK.match(body):
                    self.kinds.add("markdown")
                    body = body[t.end() :]
                number = int(n[0]) if (n := re.search(r"\d+", mark)) else 0
                self._add(node, "item", body, number or -1) if number or len(mark) == 1 else self._add(node, "para", f"{mark} {body}")
                i += 1
                continue
            if re.match(r"^\*(?=[^\s*])", bare) and not _EMPHASIS.match(bare):
                flush()
                self._add(node, "item", bare[1:], -1)
                i += 1
                continue
            if m := re.match(r"^[:;]\s+(?=\S)", bare):
                flush()
                self._add(node, "para", bare[m.end() :])
                i += 1
                continue
            para.append(line)
            i += 1
        flush()

    def _row(self, node: Node, line: str) -> None:
        cells = [self._inline(c).replace("\x02", "").replace("\x03", "").strip() for c in re.split(r"(?<!\\)\|", line.strip("|"))]
        self._put(node, Block("row", "  ".join(cells)))

    def _wiki_rows(self, node: Node, lines: list[str]) -> None:
        cells: list[str] = []
        for line in [*lines, "|-"]:
            bare = line.strip()
            if bare.startswith(("|-", "|+")):
                if cells:
                    self._put(node, Block("row", "  ".join(cells)))
                cells = [self._inline(bare[2:]).strip()] if bare.startswith("|+") and bare[2:].strip() else []
            elif bare[:1] in "|!" and bare:
                for cell in re.split(r"\|\||!!", bare[1:]):
                    cell = re.sub(r"^\s*(?:\w+\s*=\s*\"[^\"]*\"\s*)+\|", "", cell)
                    cells.append(self._inline(cell).replace("\x02", "").replace("\x03", "").strip())
            elif bare:
                cells.append(self._inline(bare).strip())

    # ---- within a line

    def _entities(self, text: str) -> str:
        def one(m: re.Match) -> str:
            name = m[0][1:]
            if name[0] != "#" and name not in html5:
                return m[0]
            self.kinds.add("html")
            return html.unescape(m[0]).replace("\xa0", " ")

        return _ENTITY.sub(one, text) if "&" in text else text

    def _note(self, kind: str, value: str) -> str:
        self.kinds.add(kind)
        return value

    def _inline(self, text: str) -> str:
        if not _CANDIDATE.search(text):
            return text
        if "`" in text:
            kept: list[str] = []

            def code(m: re.Match) -> str:
                self.kinds.add("markdown")
                kept.append(m[2].strip())
                return f"\x04{len(kept) - 1}\x05"

            text = _CODE.sub(code, text)
        else:
            kept = []
        if "$" in text or "\\" in text:
            def shown(m: re.Match) -> str:
                body = m[1] or m[2]
                if m.re is _MATH and m[2] and not _MATHLIKE.search(body):
                    return m[0]
                self.kinds.add("latex")
                kept.append(formula(body))
                return f"\x04{len(kept) - 1}\x05"

            text = _MATH.sub(shown, _DISPLAY.sub(shown, text))
            text = self._commands(text)
        text = self._entities(text)
        if "[[" in text:
            text = _WIKI_LINK.sub(lambda m: self._note("wiki", f"\x02{m[2] if m[2] else m[1]}\x03"), text)
        if "{{" in text:
            text = _TEMPLATE.sub(lambda m: self._template(m), text)
        if "](" in text or "][" in text:
            text = _LINK.sub(lambda m: self._note("markdown", f"\x02{m[1]}\x03" if m[0][0] != "!" else m[1]), text)
            text = _REFERENCE.sub(lambda m: self._note("markdown", f"\x02{m[1]}\x03") if not m[1].isdigit() else m[0], text)
        if "''" in text:
            text = _QUOTES.sub(lambda m: self._note("wiki", m[2]), text)
        if "~~" in text:
            text = _STRIKE.sub(lambda m: self._note("markdown", m[1]), text)
        if "*" in text or "_" in text:
            while (again := _EMPHASIS.sub(self._emphasis, text)) != text:
                text = again
        return re.sub("\x04(\\d+)\x05", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else "", text) if kept else text

    def _emphasis(self, m: re.Match) -> str:
        body = m[2] if m[1] else m[4]
        if not any(c.isalnum() for c in body):
            return m[0]
        return self._note("markdown", body)

    def _template(self, m: re.Match) -> str:
        parts = [p for p in (m[2] or "").split("|") if p.strip()]
        if not parts and not re.fullmatch(r"[\w :#/.-]+", m[1]):
            return m[0]
        self.kinds.add("wiki")
        return parts[-1].partition("=")[2].strip() if parts and re.match(r"^\s*\d+\s*=", parts[-1]) else parts[-1].strip() if parts else ""

    def _commands(self, text: str) -> str:
        """Commands read to what they hold, from front to back with a stack of open arguments."""
        if "\\" not in text:
            return text
        close = _closing(text)
        # an open argument: where it is read on, where it ends, what it came to; and the command it belongs to with the arguments so far
        frames: list[list] = [[0, len(text), 0, [], "", []]]
        while True:
            frame = frames[-1]
            at, end, low, out, _, _ = frame
            m = _COMMAND.search(text, at, end)
            if m:
                before = text[m.start() - 1] if m.start() > low else ""
                after = text[m.end() : m.end() + 1] if m.end() < end else ""
                known = m[1] in SYMBOLS or m[1] in SILENT or m[1] in HEADING_COMMANDS
                path = before in ("\\", ":") or (before and (before.isalnum() or before in "/._-")) and after != "{"
                if path or not (known or after == "{"):
                    out.append(text[at : m.end()])
                    frame[0] = m.end()
                    continue
                self.kinds.add("latex")
                out.append(text[at : m.start()])
                at = m.end()
                while at < end and text[at] == "[" and (stop := text.find("]", at, end)) > 0:
                    at = stop + 1
                braced = at < end and text[at] == "{"
                if m[1] in SILENT or m[1] in ("begin", "end"):
                    frame[0] = min(end, close[at] + 1) if braced else at
                elif braced:
                    frames.append([at + 1, min(end, close[at]), at + 1, [], m[1], []])
                else:
                    out.append(SYMBOLS.get(m[1], ""))
                    frame[0] = at
                continue
            out.append(text[at:end])
            if len(frames) == 1:
                break
            _, end, _, out, name, given = frames.pop()
            given.append("".join(out))
            at, whole = min(frames[-1][1], end + 1), frames[-1]
            if at < whole[1] and text[at] == "{":
                frames.append([at + 1, min(whole[1], close[at]), at + 1, [], name, given])
                continue
            whole[3].append("\x02" + given[-1] + "\x03" if name == "href" else "/".join(given) if name == "frac" else given[-1])
            whole[0] = at
        return _ESCAPE.sub(lambda m: self._note("latex", m[1]), "".join(frames[0][3]))


def _closing(text: str) -> dict[int, int]:
    """Where each opening brace is closed; the end of the text for those that are not."""
    found, stack = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            found[stack.pop()] = m.start()
    return found | dict.fromkeys(stack, len(text))


def _braced(text: str, at: int) -> tuple[str, str]:
    """The argument whose opening brace is at ``at``, and the text after it."""
    stop = _closing(text[at:])[0] + at
    return text[at + 1 : stop], text[stop + 1 :]


def formula(source: str) -> str:
    """A formula as plain characters: symbols for commands, fractions with a slash, indices and powers kept."""
    text = source.strip()
    while True:
        again = re.sub(r"\\(?:d|t)?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"(\1)/(\2)", text)
        again = re.sub(r"\\sqrt\s*\{([^{}]*)\}", r"√(\1)", again)
        again = re.sub(r"\\(?:text|mathrm|mathbf|mathit|mathcal|mathbb|operatorname|mbox|textbf|textit|vec|hat|bar|overline)\s*\{([^{}]*)\}", r"\1", again)
        again = re.sub(r"([_^])\{([^{}\s]{1,30})\}", r"\1\2", again)
        again = re.sub(r"([_^])\{([^{}]*)\}", r"\1(\2)", again)
        if again == text:
            break
        text = again
    text = re.sub(r"\\([A-Za-z]+)", lambda m: SYMBOLS.get(m[1], m[1]), text)
    text = re.sub(r"\\\\", "\n", text)
    text = re.sub(r"\\[,;:!> ]", " ", text)
    return re.sub(r"[ \t]+", " ", text.replace("\\{", "{").replace("\\}", "}").replace("&", "")).strip()


def _in_order(root: Node) -> list[tuple[Node, Node | None]]:
    """Every node with its parent, parents before children."""
    found, todo = [], [(root, None)]
    while todo:
        node, parent = todo.pop()
        found.append((node, parent))
        todo.extend((c, node) for c in reversed(node.children) if isinstance(c, Node))
    return found


def score_tree(root: Node) -> list[tuple[Node, Node | None]]:
    """Paragraphs give points for length and commas to their ancestors, halved and then thinned upward, and links discount them."""
    nodes = _in_order(root)
    above = {id(node): parent for node, parent in nodes}
    for node, _ in nodes:
        for child in node.children:
            if isinstance(child, Block) and child.kind in ("para", "item") and len(child.text) >= 25:
                points, depth, up = 1 + child.text.count(",") + min(3, len(child.text) // 100), 0, node
                while up is not None and depth < THINNED:
                    up.score += points / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
                    depth, up = depth + 1, above[id(up)]
    for node, parent in reversed(nodes):  # children before parents
        for child in node.children:
            if isinstance(child, Block):
                node.chars, node.linked, node.plain = node.chars + len(child.text), node.linked + child.linked, node.plain and child.kind not in ("code", "formula")
                node.kinds |= child.kinds
        node.score *= 1 - min(1.0, node.linked / max(1, node.chars))
        if parent is not None:
            parent.chars, parent.linked, parent.plain = parent.chars + node.chars, parent.linked + node.linked, parent.plain and node.plain
            parent.kinds |= node.kinds
    return nodes


def kept_blocks(root: Node) -> list[Block]:
    """Blocks of the best container, and of those beside it that carry structure, score enough or are prose rather than links. Kinds of markup are gathered at the root."""
    nodes = score_tree(root)
    above = {id(node): parent for node, parent in nodes}
    best = max((n for n, _ in nodes), key=lambda n: n.score)
    inside, up = set(), best
    while up is not None:
        inside.add(id(up))
        up = above[id(up)]
    threshold = max(10.0, 0.2 * best.score)
    out: list[Block] = []
    todo: list[tuple[Node | Block, bool]] = [(root, best is root)]  # a node or block, and whether all below it is kept
    while todo:
        child, whole = todo.pop()
        if isinstance(child, Block):
            if whole or child.kind in ("heading", "code", "formula", "row", "item") or child.density < 0.5:
                out.append(child)
            continue
        for x in reversed(child.children):
            if isinstance(x, Block) or whole:
                todo.append((x, whole))
            elif id(x) in inside:
                todo.append((x, x is best))
            elif x.score >= threshold or not _is_navigation(x):
                todo.append((x, True))
    return out


def _is_navigation(node: Node) -> bool:
    if not node.plain:
        return False
    return node.tag in ("nav", "aside", "footer", "form") and node.linked > 0.3 * node.chars or node.linked > 0.6 * max(1, node.chars)


def write_blocks(blocks: list[Block]) -> str:
    """Headings between blank lines, as they are written, behind a section sign for each level; lists with bullets or numbers, code indented, formulas and table rows on their own lines."""
    out: list[str] = []
    last = ""
    for b in blocks:
        if b.kind == "heading":
            text = "§" * max(1, b.level) + " " + b.text
        elif b.kind == "item":
            text = (f"{b.level}. " if b.level > 0 else "- ") + re.sub(r"\s*\n\s*", " ", b.text)
        elif b.kind in ("code", "formula"):
            text = "\n".join("    " + line for line in b.text.split("\n"))
        else:
            text = b.text
        if out:
            out.append("\n" if b.kind == last and b.kind in ("item", "row") else "\n\n")
        out.append(text)
        last = b.kind
    return "".join(out)


def clean_markup(text: str) -> tuple[list[str], str, bool]:
    """(kinds of markup, as the nodes of the tree carry them; clean text; has headings). Text without markup comes back unchanged."""
    parser = Parser(text)
    blocks = kept_blocks(parser.root)
    kinds = sorted(parser.root.kinds)
    if not kinds:
        return [], text, parser.headed
    return kinds, write_blocks(blocks), parser.headed


def clean_documents(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, markup, text, has_headers) of every row whose text carries markup; markup lists its kinds, sorted.

    Text without a sign that could be markup never leaves the JVM. Null and empty texts give no rows; rows loaded twice count once.
    """
    kinds = pa.schema([("k", pa.string()), ("markup", pa.list_(pa.string())), ("text", pa.string()), ("has_headers", pa.bool_())])

    def work(k, given):
        found, clean, headed = clean_markup(given)
        if found:
            yield k, found, clean, headed

    once = one_per_key(df.filter(F.col(text).rlike(r"[<&#*_`~\[\]{}\\$|]|''|--|==")).select(key, text), key)
    rows = once.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return map_rows(rows, "k string, markup array<string>, text string, has_headers boolean", kinds, work).withColumnRenamed("k", key)
