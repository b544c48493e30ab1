"""What a task holds stays bounded on the texts that fill its tables fastest."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import numpy as np
import pytest

from gridweave.llm import decontaminate as dc
from gridweave.llm import tokencount

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..")
CASES = {
    "equal words in item and text": """
from gridweave.llm import decontaminate as dc
b = dc.Benchmark([("1", "same " * 200)], 10)
text = "same " * 400_000
start()
counts, found = dc.find(b, [text])
lists = dc.match_lists(b, found, 1)
assert counts[0] == 400_000 and len(found) == 399_991 + 190, len(found)
""",
    "one long pre-token": """
import random, public_tokenizers
from gridweave.llm import tokencount as t
c = t.counter(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
rnd = random.Random(1)
text = "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(1_000_000))
start()
assert c[text] > 900_000
""",
    "many lines without spaces": """
import random, public_tokenizers
from gridweave.llm import bpe
e = bpe.encoder(bpe.tokenizer_text(public_tokenizers.path("byte_bpe_50k.json")))
rnd = random.Random(1)
start()
for _ in range(100_000):
    e.encode("".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(120)))
""",
}


@pytest.mark.parametrize("case", CASES)
def test_less_than_300_mb(case):
    code = ("import resource\nbase = 0\ndef start():\n    global base\n    base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
            + CASES[case] + "\nprint('MB', (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)")
    paths = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": paths}, capture_output=True, text=True, timeout=600, check=False)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split("MB")[1]) < 300


def test_longest_matches_of_repeated_words():
    """Every longest match once, against all pairs of places."""
    rnd = random.Random(8)
    for _ in range(60):
        items = [(str(i), " ".join(rnd.choice("ab") for _ in range(rnd.choice([3, 6, 20])))) for i in range(3)]
        texts = [" ".join(rnd.choice("aab") for _ in range(rnd.choice([0, 5, 40]))) + " c" for _ in range(3)]
        window = rnd.choice([2, 4])
        benchmark = dc.Benchmark(items, window)
        _, found = dc.find(benchmark, texts)
        want = set()
        for t, text in enumerate(texts):
            words = text.split()
            for k, (_, item) in enumerate(items):
                own = item.split()
                for a in range(len(own)):
                    for p in range(len(words)):
                        if words[p] != own[a] or (a and p and words[p - 1] == own[a - 1]):
                            continue
                        n = 0
                        while a + n < len(own) and p + n < len(words) and own[a + n] == words[p + n]:
                            n += 1
                        if n >= min(window, len(own)):
                            want.add((t, k, a, p, n))
        assert sorted(map(tuple, found.tolist())) == sorted(want)


def test_a_shared_prefix_ends_where_letters_are_no_longer_kept():
    scores = {"a": -1.0, "aa": -1.5, "▁": -2.0, "b": -1.0, "aab": -2.0}
    trie, rnd = tokencount.Trie(scores, -30.0), random.Random(3)
    for _ in range(50):
        word = "".join(rnd.choice("aab") for _ in range(rnd.choice([1, 60, 63, 64, 65, 200])))
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(word)
        for i in range(1, len(word) + 1):
            for piece, value in scores.items():
                if word[:i].endswith(piece):
                    was = best[i - len(piece)]
                    if (was[0] + value, -was[1] - 1) > (best[i][0], -best[i][1]):
                        best[i] = (was[0] + value, was[1] + 1)
        assert trie.tokens(word) == best[-1][1]
    assert trie.nodes < 50 * (tokencount.SHARED_LETTERS + 1)
