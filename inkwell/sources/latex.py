"""LaTeX sources as plain text, in one pass over their tokens with a stack of open groups and environments.

Braces nest without limit, which patterns can't follow; so this is an Arrow UDF whose work is linear in a text's length. Null
gives null. A group or environment that is never closed stays as it is written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLOCK = "\n\n"
#: What stands before and after the argument of a command.
AROUND = (
    dict.fromkeys("part chapter section subsection subsubsection paragraph title author".split(), (BLOCK, BLOCK))
    | dict.fromkeys("textbf textit emph underline texttt textsc textrm textsf mbox text uline url".split(), ("", ""))
    | {"footnote": (" (", ")")}
)
#: Commands that go alone, and those that go with their argument.
LAYOUT = frozenset("maketitle tableofcontents newpage clearpage centering noindent small large Large footnotesize keywords printbibliography".split())
SILENT = frozenset("label vspace hspace bibliography bibliographystyle".split())
FLOATS = frozenset(("figure", "table"))
DISPLAYS = frozenset("equation align gather multline eqnarray displaymath".split())
TYPOGRAPHY = (("``", "“"), ("''", "”"), ("~", " "), ("---", "—"), ("--", "–"))
ESCAPED = frozenset("%&$#_{}")
BLANK = " \t\n\r\f"

TOKEN = re.compile(
    r"(?P<note>\\begin\{comment\}.*?\\end\{comment\}|%[^\n]*)|\\(?P<edge>begin|end)\{(?P<env>[A-Za-z]+)\*?\}|\\(?P<name>[A-Za-z]+)\*?|\\(?P<mark>.)|(?P<brace>[{}])|(?P<text>[^\\{}%]+|\\)",
    re.DOTALL,
)
OPTION, GROUP, OPTIONS = re.compile(r"\[[^\]]*\]"), re.compile(r"\{[^}]*\}"), re.compile(r"(?:\{[^}]*\}|\[[^\]]*\])*")
GAP, PAUSE, FOLD, WIDE = re.compile(r"[ \t\n\r\f]*"), re.compile(r"\n[ \t\n\r\f]*\n"), re.compile(r"[ \t\n\r\f]*\n[ \t\n\r\f]*"), re.compile(r"[ \t]{2,}")


@dataclass
class Open:
    """A group or environment that is being read: how it was written, what its parts become, what goes around them."""

    written: str
    name: str = ""
    around: tuple[str, str] = ("{", "}")
    env: str | None = None
    parts: list[str] = field(default_factory=list)
    caption: str | None = None  # of a float
    address: str | None = None  # the first argument of a link, once read

    def closed(self) -> str:
        inside = "".join(self.parts)
        if self.env in FLOATS:
            inside = self.caption or ""
        elif self.env in DISPLAYS:
            inside = inside.strip(BLANK)
        return self.around[0] + inside + self.around[1]


def _skip(pattern: re.Pattern, s: str, at: int) -> int:
    m = pattern.match(s, at)
    return m.end() if m else at


def _lose(stack: list[Open]) -> None:
    """What was opened last is never closed: it stays as written."""
    lost = stack.pop()
    stack[-1].parts.append(lost.written + "".join(lost.parts))


def _environment(env: str, written: str) -> Open:
    around = {"thebibliography": (BLOCK + "References" + BLOCK, ""), "abstract": (BLOCK + "Abstract" + BLOCK, BLOCK)}.get(env, (BLOCK, BLOCK))
    return Open(written, around=("$$", "$$") if env in DISPLAYS else around, env=env)


def plain(source: str) -> str:
    """Captions of floats, $$ around displayed formulas, headings and items as paragraphs, formatting taken off, entries of
    a bibliography numbered; citation commands and inline formulas stay for the protection step."""
    s = source.replace("\r\n", "\n").replace("\r", "\n")
    s = s.partition("\\begin{document}")[2] or s
    s = s.partition("\\end{document}")[0]
    stack, at, entries = [Open("")], 0, 0
    while at < len(s):
        m = TOKEN.match(s, at)
        top, at, written = stack[-1], m.end(), m[0]
        kind, name = m.lastgroup, m["name"]
        if kind == "note":
            continue
        if kind == "text":
            for a, b in TYPOGRAPHY:
                written = written.replace(a, b)
            top.parts.append(written)
        elif kind == "mark":
            top.parts.append(m["mark"] if m["mark"] in ESCAPED else "\n" if m["mark"] == "\\" else written)
        elif kind == "env":
            at = _skip(OPTIONS, s, at) if m["env"] not in DISPLAYS else at
            if m["edge"] == "begin":
                stack.append(_environment(m["env"], written))
            elif any(x.env == m["env"] for x in stack):
                while stack[-1].env != m["env"]:
                    _lose(stack)
                ended = stack.pop()
                stack[-1].parts.append(ended.closed())
            else:
                top.parts.append(BLOCK)
        elif written == "{":
            stack.append(Open(written))
        elif written == "}":
            if len(stack) == 1 or top.env:
                top.parts.append(written)
                continue
            stack.pop()
            below = stack[-1]
            if top.name == "href" and top.address is None and s.startswith("{", at):
                address = "".join(top.parts)
                stack.append(Open(top.written + address + "}{", "href", address=address))
                at += 1
            elif top.name == "href":
                below.parts.append("".join(top.parts) + f" ({top.address})" if top.address is not None else top.written + "".join(top.parts) + "}")
            elif top.name == "caption":
                held = "".join(top.parts)
                below.caption = held if below.caption is None else below.caption
            else:
                below.parts.append(top.closed())
        elif name == "item":
            at = _skip(GAP, s, _skip(OPTION, s, at))
            top.parts.append(BLOCK)
        elif name == "bibitem":
            entries += 1
            at = _skip(GAP, s, _skip(GROUP, s, _skip(OPTION, s, at)))
            top.parts.append(f"{BLOCK}[{entries}] ")
        elif name in LAYOUT:
            at = _skip(OPTION, s, at) if name == "printbibliography" else at
        elif name in SILENT:
            at = _skip(GROUP, s, at)
        else:
            begins = _skip(OPTION, s, at)
            known = name in AROUND or name == "href" or (name == "caption" and top.env in FLOATS)
            if known and s.startswith("{", begins):
                stack.append(Open(s[m.start() : begins + 1], name, AROUND.get(name, ("", ""))))
                at = begins + 1
            else:
                top.parts.append(written)
    while len(stack) > 1:
        _lose(stack)
    text = WIDE.sub(" ", "".join(stack[0].parts))  # first, so that no pattern below runs along blanks again and again
    blocks = (FOLD.sub(" ", p).strip(BLANK) for p in PAUSE.split(text))
    return BLOCK.join(p for p in blocks if p)


def _plain_all(source: pd.Series) -> pd.Series:
    return source.map(plain, na_action="ignore")


def latex_text(source: Column) -> Column:
    return F.pandas_udf(_plain_all, StringType())(source)
