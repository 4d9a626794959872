"""Masks of source text: what is no code is blanked, so that brackets and words in it do not count.

A mask has the shape of its text. Modes are kept on a stack: code, a template and the code in its
holes. Whether a slash divides or begins a regular expression depends on the token before it.
"""

from __future__ import annotations

import re

PAIRS = {"(": ")", "[": "]", "{": "}"}

_SCRIPT = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<word>[\w$]+)|(?P<step>\+\+|--|=>|</)|(?P<mark>.)""",
    re.S | re.X,
)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_GO = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`""", re.S)
_BRACKET = re.compile(r"[(){}\[\]]")

# Words that an operand follows, words whose parenthesis a statement follows, words that a block follows.
_BEFORE_OPERAND = frozenset("await case delete do else extends in instanceof new of return throw typeof void yield".split())
_BEFORE_CONDITION = frozenset("for if while with".split())
_BEFORE_BLOCK = frozenset("do else finally try".split())


def _blank(part: str) -> str:
    return re.sub(r"[^\n]", " ", part)


def _hollow(part: str) -> str:
    """A literal with its quotes kept and all between them blanked."""
    return part[0] + _blank(part[1:-1]) + part[-1]


def mask_script(text: str) -> str:
    """Mask of JavaScript or TypeScript."""
    out: list[str] = []
    at, value = 0, False  # whether the token before is the end of an operand, so that a slash divides
    last = ""
    opened: list[tuple[str, bool]] = []  # open brackets, and whether an operand ends where they close

    def template(at: int) -> int:
        """The text of a template from `at` to its end or its next hole."""
        end = _TEMPLATE.match(text, at).end()
        out.append(_blank(text[at:end]))
        if text.startswith("${", end):
            out.append(" {")
            opened.append(("`", False))
            return end + 2
        out.append(text[end : end + 1])
        return end + 1

    while at < len(text):
        m = _SCRIPT.match(text, at)
        kind, token = m.lastgroup, m[0]
        at = m.end()
        if kind == "space":
            out.append(token)
            continue
        if kind == "comment":
            out.append(_blank(token))
            continue
        if kind == "string":
            out.append(_hollow(token))
            value = True
        elif kind == "word":
            out.append(token)
            value = token not in _BEFORE_OPERAND or last == "."
        elif kind == "step":
            out.append(token)
            value = value and token in ("++", "--")
        elif token == "`":
            out.append(token)
            begun = len(opened)
            at = template(at)
            value = len(opened) == begun  # in a hole an operand is next
        elif token == "/" and not value and (r := _REGEX.match(text, m.start())):
            out.append(_blank(r[0]))
            at, value = r.end(), True
        elif token in PAIRS:
            out.append(token)
            if token == "(":
                opened.append((token, last not in _BEFORE_CONDITION))
            elif token == "{":
                block = last in ("", ")", "=>", ";", "{", "}") or last in _BEFORE_BLOCK or (last.isidentifier() and last not in _BEFORE_OPERAND)
                opened.append((token, not block))
            else:
                opened.append((token, True))
            value = False
        elif token in ")]}":
            out.append(token)
            how, ends = opened.pop() if opened else (token, True)
            if how == "`" and token == "}":
                begun = len(opened)
                at = template(at)
                value = len(opened) == begun
            else:
                value = ends
        else:
            out.append(token)
            value = False
        last = token
    return "".join(out)


def mask_go(text: str) -> str:
    """Mask of Go: strings, raw strings (in which a backslash is only that), runes and comments."""
    return _GO.sub(lambda m: _blank(m[0]) if m[0][0] == "/" else _hollow(m[0]), text)


def closing(mask: str, at: int) -> int:
    """The place of the bracket that closes the one at `at`; the end of the text if none does."""
    depth, open_, close = 0, mask[at], PAIRS[mask[at]]
    for m in _BRACKET.finditer(mask, at):
        if m[0] == open_:
            depth += 1
        elif m[0] == close:
            depth -= 1
            if not depth:
                return m.start()
    return len(mask) - 1


def after_space(mask: str, at: int, spaces: str = " \t\r\n") -> int:
    while at < len(mask) and mask[at] in spaces:
        at += 1
    return at


_GO_NAME = re.compile(r"\w+(?:\s*\.\s*\w+)?")


def go_type_end(mask: str, at: int) -> int | None:
    """Where the Go type that begins at `at` ends; None if there is none on its line."""
    at = after_space(mask, at, " \t")
    c = mask[at : at + 1]
    if c == "*":
        return go_type_end(mask, at + 1)
    if c == "[":
        return go_type_end(mask, closing(mask, at) + 1)
    if c == "(":
        return closing(mask, at) + 1
    if mask.startswith("<-", at):
        return go_type_end(mask, at + 2)
    m = _GO_NAME.match(mask, at)
    if not m:
        return None
    if m[0] == "chan":
        at = after_space(mask, m.end(), " \t")
        return go_type_end(mask, at + 2 if mask.startswith("<-", at) else at)
    if m[0] == "map":
        at = after_space(mask, m.end(), " \t")
        return go_type_end(mask, closing(mask, at) + 1) if mask[at : at + 1] == "[" else None
    if m[0] in ("struct", "interface"):
        at = after_space(mask, m.end(), " \t")
        return closing(mask, at) + 1 if mask[at : at + 1] == "{" else None
    if m[0] == "func":
        at = after_space(mask, m.end(), " \t")
        if mask[at : at + 1] != "(":
            return None
        end = closing(mask, at) + 1
        follows = after_space(mask, end, " \t")
        return end if mask[follows : follows + 1] in ("{", "", "\n", ",", ")") else go_type_end(mask, end) or end
    at = m.end()
    return closing(mask, at) + 1 if mask[at : at + 1] == "[" else at


def go_body(mask: str, params: int) -> int | None:
    """The brace that opens the body of the function whose parameters open at `params`; None for one
    without a body."""
    at = after_space(mask, closing(mask, params) + 1, " \t")
    if mask[at : at + 1] != "{":
        end = go_type_end(mask, at)
        if end is None:
            return None
        at = after_space(mask, end, " \t")
    return at if mask[at : at + 1] == "{" else None


_TYPE_TOKEN = re.compile(r"\s+|=>|[\w$.]+|.", re.S)
#: After these in a type, a brace opens an object type and no body.
_TYPE_GOES_ON = frozenset((":", "|", "&", "<", ",", "?", "=>", "is", "extends", "keyof", "typeof", "readonly", "infer"))


def script_body(mask: str, params: int, arrow: bool = False) -> int | None:
    """The brace that opens the block after a parameter list that opens at `params`, whatever return type
    is between; for an arrow function the one after its arrow. None if there is no block."""
    at = after_space(mask, closing(mask, params) + 1)
    if mask[at : at + 1] != ":":
        if arrow:
            if not mask.startswith("=>", at):
                return None
            at = after_space(mask, at + 2)
        return at if mask[at : at + 1] == "{" else None
    last, at = ":", at + 1
    while at < len(mask):
        m = _TYPE_TOKEN.match(mask, at)
        token = m[0]
        if token.isspace():
            at = m.end()
            if "\n" in token and last not in _TYPE_GOES_ON and not mask.startswith(("{", "|", "&", "=>"), at):
                return None
            continue
        if token == "{" and (last == "=>" if arrow else last not in _TYPE_GOES_ON):
            return at
        if token in PAIRS:
            at = closing(mask, at) + 1
            last = PAIRS[token]
            continue
        if token in (";", "=", ")", "]", "}"):
            return None
        at, last = m.end(), token
    return None
