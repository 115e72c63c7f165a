import random
import shutil
import subprocess

import pytest

from glintsieve.functions import patch


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_scripts_are_shortest_and_patches_fit():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.choice("abcd") + "\n" for _ in range(rng.randrange(14))]
        b = [x for x in a if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcde") + "\n")
        steps = patch.script(a, b)
        assert [a[x] for kind, x, _ in steps if kind != "+"] == a and [b[y] for kind, _, y in steps if kind != "-"] == b
        assert all(a[x] == b[y] for kind, x, y in steps if kind == " ")
        assert sum(kind != " " for kind, _, _ in steps) == _distance(a, b)
        before, after = "".join(a), "".join(b)
        if rng.random() < 0.3:
            before, after = before.rstrip("\n"), after + "end"
        for context in (0, 1, 3):
            found = patch.unified(before, after, "p", context)
            assert patch.applied(before, found) == after and (found == "") == (before == after)


def test_a_patch_that_does_not_fit():
    with pytest.raises(ValueError):
        patch.applied("x\n", patch.unified("a\n", "b\n", "p"))


@pytest.mark.skipif(not shutil.which("patch"), reason="needs the patch program")
def test_the_patch_program_reads_them(tmp_path):
    before, after = "".join(f"l{k}\n" for k in range(40)), "".join(f"l{k}\n" if k not in (3, 30) else f"new{k}\n" for k in range(41))
    (tmp_path / "f").write_text(before)
    (tmp_path / "d").write_text(patch.unified(before, after, "f"))
    subprocess.run(["patch", str(tmp_path / "f"), str(tmp_path / "d")], check=True, capture_output=True)
    assert (tmp_path / "f").read_text() == after
