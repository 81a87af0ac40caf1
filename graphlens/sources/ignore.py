"""Ignore rules of a source tree: glob patterns, their precedence, and the predicate."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

# Folders that are never scanned; the third is this engine's own.
BUILTIN = (".git", ".graphlens", "graphlens-data", "node_modules", "vendor", "dist", "build", "target", "__pycache__", ".pytest_cache")
CUSTOM_FILE, GIT_FILE, EXCLUDE_FILE = ".graphlensignore", ".gitignore", ".git/info/exclude"


def pattern_regex(glob: str) -> str:
    """Regular expression of a glob: * and ? stay within a name, ** crosses folders."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            at_start, j = i == 0 or glob[i - 1] == "/", i + 2
            if at_start and glob.startswith("/", j):
                out.append("(?:[^/]+/)*")
                i = j + 1
                continue
            out.append(".*")
            i = j
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            j = glob.find("]", i + 2)
            if j < 0:
                out.append(r"\[")
            else:
                body = glob[i + 1 : j].replace("\\", "\\\\")
                out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
                i = j
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    regex: re.Pattern
    negated: bool
    folders_only: bool


def parse(text: str) -> list[Rule]:
    """Rules of an ignore file, in order; blank lines, comments and bad patterns are none."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        if negated or line.startswith(("\\!", "\\#")):
            line = line[1:]
        folders_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        if not line:
            continue
        try:
            regex = re.compile(("" if anchored else "(?:.*/)?") + pattern_regex(line) + r"\Z")
        except re.error:
            continue
        rules.append(Rule(regex, negated, folders_only))
    return rules


@dataclass
class IgnoreRules:
    """All ignore files of a tree: folder -> rules, by kind of file."""

    custom: dict[str, list[Rule]] = field(default_factory=dict)
    git: dict[str, list[Rule]] = field(default_factory=dict)
    exclude: list[Rule] = field(default_factory=list)
    builtin: tuple[str, ...] = BUILTIN

    @classmethod
    def of(cls, files: Iterable[tuple[str, str]]) -> IgnoreRules:
        """files: (path, text) of the tree's ignore files."""
        out = cls()
        for path, text in files:
            folder, _, name = path.rpartition("/")
            if path == EXCLUDE_FILE:
                out.exclude = parse(text)
            elif name == CUSTOM_FILE:
                out.custom[folder] = parse(text)
            elif name == GIT_FILE:
                out.git[folder] = parse(text)
        return out

    @staticmethod
    def _decide(rules: list[Rule], path: str, is_folder: bool) -> bool | None:
        """True: ignored, False: kept, None: not said; the last rule that fits decides."""
        for rule in reversed(rules):
            if (is_folder or not rule.folders_only) and rule.regex.match(path):
                return not rule.negated
        return None

    def _one(self, path: str, is_folder: bool) -> bool:
        """Whether this path itself is ignored, whatever holds for its folders."""
        if path.rsplit("/", 1)[-1] in self.builtin:
            return True
        parts = path.split("/")
        for files in (self.custom, self.git):
            for i in range(len(parts) - 1, -1, -1):  # the deepest file decides first
                folder = "/".join(parts[:i])
                if folder in files:
                    said = self._decide(files[folder], "/".join(parts[i:]), is_folder)
                    if said is not None:
                        return said
        return bool(self._decide(self.exclude, path, is_folder))

    def matched(self, path: str, is_folder: bool = False) -> bool:
        """Whether a path of the tree is ignored: an ignored folder above it decides."""
        if path.startswith(("/", "../")):
            return False  # outside of the tree
        parts = path.split("/")
        for i in range(1, len(parts)):
            if self._one("/".join(parts[:i]), True):
                return True
        return self._one(path, is_folder)
