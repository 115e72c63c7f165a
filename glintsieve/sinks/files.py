"""Files that the driver writes: new only, private, never over another file."""

from __future__ import annotations

import os
import shutil


def write_new(path: str, body: str) -> None:
    """Creates a file for its owner only; an existing one is an error."""
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(body)


def write_cases(folder: str, records: list[tuple[str, str]]) -> int:
    """A new private folder with a file for each case; on failure it is removed again."""
    os.mkdir(folder, 0o700)
    try:
        for name, body in records:
            write_new(os.path.join(folder, f"{name}.json"), body)
    except OSError:
        shutil.rmtree(folder)
        raise
    return len(records)


TEMPLATES = {
    ".glintsieve.toml": 'fail_on = "high"\nexclude = []\n',
    ".github/workflows/glintsieve.yml": "name: scan\non: [push]\njobs:\n  scan:\n    runs-on: ubuntu-latest\n    steps:\n      - uses: actions/checkout@v4\n      - run: python -m glintsieve scan .\n",
    ".git/hooks/pre-commit": "#!/bin/sh\nexec python -m glintsieve scan .\n",
}


def init(root: str, names: list[str]) -> list[str]:
    """Writes the named templates where nothing stands yet."""
    out = []
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        write_new(path, TEMPLATES[name])
        out.append(path)
    return out


def repaired(content: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The content with True in the byte ranges, each of which must hold False."""
    for a, b in sorted(ranges, reverse=True):
        if content[a:b] != b"False":
            raise ValueError("the file has changed")
        content = content[:a] + b"True" + content[b:]
    return content


def apply_repair(path: str, ranges: list[tuple[int, int]]) -> None:
    """Repairs a file in place by rename; a byte-exact copy stays beside it."""
    with open(path, "rb") as f:
        content = f.read()
    new = repaired(content, ranges)
    for name, data in ((path + ".orig", content), (path + ".new", new)):
        handle = os.open(name, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(handle, "wb") as f:
            f.write(data)
    os.replace(path + ".new", path)
