"""One document's sentences, sections and blocks of talk; texts are normalised (see ``chunking.normalise``).

White space means the six ASCII characters everywhere, as in the expressions of ``chunking``.
"""

from __future__ import annotations

import regex

# fixed values
MIN_BYTES, BLOCK_BYTES, TIME_BYTES, TITLE_CHARS, SENTENCE_WORDS = 30, 20, 8, 80, 4

WHITE = " \t\n\x0b\f\r"
_CUT = regex.compile(r"[.!?](?=[ \n]*(?:[\p{Lu}\"'(]|\Z))")
_TIME = regex.compile(r"[0-9:]*")
_CAPITAL = regex.compile(r"\p{Lu}")


def lines(text: str) -> list[str]:
    """Lines without a last empty one."""
    out = text.split("\n")
    return out[:-1] if out[-1] == "" else out


def sentences(text: str) -> list[str]:
    out, begin, words, at = [], 0, 0, 0
    for m in _CUT.finditer(text):
        end = m.end()
        words += len(text[at:end].encode().split())  # bytes are split at the six white space characters alone
        if at > begin and text[at] not in WHITE:
            words -= 1  # the word goes on over the cut
        at = end
        if words >= SENTENCE_WORDS:
            out.append(text[begin:end].strip(WHITE))
            begin, words = end, 0
    rest = text[begin:].strip(WHITE)
    return [*out, rest] if rest else out


def is_header(line: str) -> bool:
    s = line.strip(WHITE)
    if s.startswith("#"):
        return len(s.lstrip("#").strip(WHITE).encode()) >= 3
    if s[:1] and s[0] in "0123456789":
        rest = s.lstrip("0123456789.").strip(WHITE)
        return 2 <= len(rest.encode()) <= 80 and _CAPITAL.match(rest) is not None and not rest.endswith(".")
    return False


def sections(text: str) -> list[list[str]]:
    """[title, title and body] of each header's section."""
    found: list[tuple[str, list[str]]] = []
    inside = False
    for line in lines(text):
        if line.strip(WHITE).startswith("```"):
            inside = not inside
        elif not inside and is_header(line):
            found.append((line.strip(WHITE), []))
            continue
        if found:
            found[-1][1].append(line)
    if len(found) < 2:
        return []
    bodies = ["\n".join(b).strip(WHITE) for _, b in found]
    return [[title, f"{title}\n{body}"] for k, ((title, _), body) in enumerate(zip(found, bodies, strict=True)) if len(body.encode()) >= MIN_BYTES or k + 1 == len(found)]


def spoken(text: str) -> list[str]:
    """Trimmed lines that are neither empty nor only a time."""
    own = (line.strip(WHITE) for line in lines(text))
    return [s for s in own if s and not (len(s.encode()) <= TIME_BYTES and _TIME.fullmatch(s))]


def blocks(text: str) -> list[list[str]] | None:
    """[title, text] of each question with what follows it; None where there are fewer than two questions."""
    own = spoken(text)
    if sum(s.endswith("?") for s in own) < 2:
        return None
    found: list[list[str]] = [[]]
    for s in own:
        if s.endswith("?"):
            found.append([])
        found[-1].append(s)
    out = []
    for k, b in enumerate(found):
        t = " ".join(b).strip(WHITE)
        if b and len(t.encode()) >= (BLOCK_BYTES if k else MIN_BYTES):
            out.append([b[0][:TITLE_CHARS] if k else "Introduction", t])
    return out
