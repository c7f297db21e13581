"""Edit blocks and unified diffs: parsing, applying, canonical form. Pure functions and their Arrow UDFs.

A text is cut into lines as a compiler's line reader does: at line feeds, a carriage return before
one dropped, no line after a final line feed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from mendframe.functions import arrow_udf

# The markers of an edit block and the default limit of changed lines.
SEARCH, DIVIDER, REPLACE = "<<<<<<< SEARCH", "=======", ">>>>>>> REPLACE"
MAX_CHANGED_LINES = 60


@dataclass(frozen=True)
class Block:
    file: str
    search: str
    replace: str


class PatchError(ValueError):
    """``kind`` is not_found, ambiguous, no_op, too_large or malformed; ``detail`` says more."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind, self.detail = kind, detail


def lines_of(text: str) -> list[str]:
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def squeeze(line: str) -> str:
    """White space trimmed and collapsed."""
    return " ".join(line.split())


def _marked(lines: list[str]) -> list[tuple[int, str]]:
    return [(i, m) for i, x in enumerate(lines) if (m := x.rstrip()) in (SEARCH, DIVIDER, REPLACE)]


def parse_edit_blocks(text: str, default_file: str | None = None) -> list[Block]:
    """SEARCH/REPLACE blocks in order; of a text without any, the hunks of a unified diff.

    ``file: path`` on the line before a block names its file, else ``default_file`` does. Markers stand
    alone on their line. Stray dividers and ends outside a block are prose.
    """
    lines = lines_of(text)
    blocks, inside = [], []
    for i, mark in _marked(lines):
        if not inside:
            if mark == SEARCH:
                hint = lines[i - 1].strip() if i else ""
                file = hint[5:].strip() if hint.startswith("file:") else ""
                if not (file or default_file):
                    raise PatchError("malformed", "no file named")
                inside = [(i, file or default_file)]
        elif len(inside) == 1 and mark == DIVIDER:
            inside.append((i, None))
        elif len(inside) == 2 and mark == REPLACE:
            (a, file), (b, _) = inside
            blocks.append(Block(file, "\n".join(lines[a + 1 : b]), "\n".join(lines[b + 1 : i])))
            inside = []
        else:
            raise PatchError("malformed", "marker before the divider" if len(inside) == 1 else "marker inside the replacement")
    if inside:
        raise PatchError("malformed", "no divider" if len(inside) == 1 else "no end of the replacement")
    return blocks or parse_hunks(lines, default_file)


def parse_hunks(lines: list[str], default_file: str | None) -> list[Block]:
    """One block per ``@@`` hunk: context and removed lines against context and added lines."""
    file, blocks, hunk = default_file, [], None

    def close():
        if hunk is not None:
            blocks.append(Block(hunk[0], "\n".join(hunk[1]), "\n".join(hunk[2])))

    for x in lines:
        head = x.startswith(("@@", "--- ", "+++ ", "diff "))
        if hunk is not None and not head:
            if x.startswith("\\"):
                continue
            sign, rest = (x[0], x[1:]) if x else (" ", "")
            if sign in " +-":
                if sign != "+":
                    hunk[1].append(rest)
                if sign != "-":
                    hunk[2].append(rest)
                continue
        close()
        hunk = None
        if x.startswith("+++ "):
            name = x[4:].strip().removeprefix("b/")
            file = name if name not in ("", "/dev/null") else file
        elif x.startswith("@@"):
            if not file:
                raise PatchError("malformed", "diff without a file")
            hunk = (file, [], [])
    close()
    return blocks


def occurrences(text: str, part: str) -> list[int]:
    """Starts of all occurrences, overlapping ones too; none of an empty part."""
    return [m.start() for m in re.finditer(f"(?={re.escape(part)})", text)] if part else []


def _loose(text: str, block: Block) -> str | None:
    """``text`` with the only run of lines that equals the search but for white space replaced."""
    wanted = [squeeze(x) for x in lines_of(block.search)]
    have = re.findall(r"[^\n]*\n|[^\n]+", text)
    plain = [squeeze(x) for x in have]
    n = len(wanted)
    hits = [i for i in range(len(plain) - n + 1) if plain[i : i + n] == wanted] if n else []
    if len(hits) != 1:
        return None
    i = hits[0]
    glue = "\n" if have[i + n - 1].endswith("\n") and not block.replace.endswith("\n") else ""
    return "".join(have[:i]) + block.replace + glue + "".join(have[i + n :])


def apply_block(text: str, block: Block, cap: int = MAX_CHANGED_LINES, loose: bool = True) -> tuple[str, bool]:
    """(new text, whether white space had to be ignored). A search longer than the text isn't found."""
    if block.search == block.replace:
        raise PatchError("no_op", block.file)
    changed = len(lines_of(block.search)) + len(lines_of(block.replace))
    if changed > cap:
        raise PatchError("too_large", f"{changed} > {cap}")
    at = occurrences(text, block.search)
    if len(at) > 1:
        raise PatchError("ambiguous", str(len(at)))
    if at:
        return text[: at[0]] + block.replace + text[at[0] + len(block.search) :], False
    new = _loose(text, block) if loose else None
    if new is None:
        raise PatchError("not_found", block.file)
    return new, True


def apply_patch(text: str, patch: str, default_file: str = "candidate.py", cap: int = MAX_CHANGED_LINES, loose: bool = True) -> tuple[str, bool, int]:
    """(new text, whether any block was loose, blocks); the first block that fails stops all."""
    blocks = parse_edit_blocks(patch, default_file)
    any_loose = False
    for b in blocks:
        text, was = apply_block(text, b, cap, loose)
        any_loose |= was
    return text, any_loose, len(blocks)


def canonical_patch(patch: str, default_file: str | None = None) -> str:
    """The same edits as SEARCH/REPLACE blocks that each name their file."""
    blocks = parse_edit_blocks(patch, default_file)
    if not blocks:
        raise PatchError("malformed", "no edits")
    return "\n".join(f"file: {b.file}\n{SEARCH}\n{b.search}\n{DIVIDER}\n{b.replace}\n{REPLACE}" for b in blocks)


def replay_equal(text: str, patch: str, default_file: str = "candidate.py") -> bool:
    """Whether patch and its canonical form give the same text."""
    try:
        return apply_patch(text, patch, default_file)[0] == apply_patch(text, canonical_patch(patch, default_file), default_file)[0]
    except PatchError:
        return False


PARSED = "blocks array<struct<file:string,search:string,replace:string>>, error string"
APPLIED = "content string, loose boolean, blocks int, error string"


@arrow_udf(PARSED)
def parse_udf(patch: pd.Series, default_file: pd.Series) -> pd.DataFrame:
    """Blocks of a patch or the kind of its error; a null patch has no blocks."""

    def one(p, d):
        try:
            return [b.__dict__ for b in parse_edit_blocks(p or "", d)], None
        except PatchError as e:
            return None, e.kind

    return pd.DataFrame([one(p, d) for p, d in zip(patch, default_file)], columns=["blocks", "error"], dtype=object)


@arrow_udf(APPLIED)
def apply_udf(content: pd.Series, patch: pd.Series, default_file: pd.Series) -> pd.DataFrame:
    """A content after all edits of a patch, or the kind of the first error; null where content is null."""

    def one(c, p, d):
        if c is None:
            return None, None, None, None
        try:
            return (*apply_patch(c, p or "", d or "candidate.py"), None)
        except PatchError as e:
            return None, None, None, e.kind

    return pd.DataFrame([one(*r) for r in zip(content, patch, default_file)], columns=["content", "loose", "blocks", "error"], dtype=object)


@arrow_udf("string")
def canonical_udf(patch: pd.Series, default_file: pd.Series) -> pd.Series:
    """The canonical form, null where there is none."""

    def one(p, d):
        try:
            return canonical_patch(p or "", d)
        except PatchError:
            return None

    return pd.Series([one(p, d) for p, d in zip(patch, default_file)], dtype=object)
