"""What packing keeps in a Python worker, and that freed memory goes back to the system."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from reviewlens.llm.best_two_fit import WordIds


class Encoded:
    def __init__(self, text: str):
        self.ids = [ord(c) for c in text]


class Letters:
    """A tokenizer of one id a character."""

    def __init__(self):
        self.largest = 0

    def encode_batch_fast(self, texts, add_special_tokens):
        self.largest = max(self.largest, len(texts))
        return [Encoded(t) for t in texts]


def plain(texts):
    return [b"".join(ord(c).to_bytes(4, "little") for c in t) for t in texts]


def test_words_met_once_leave_the_table():
    known = WordIds(Letters(), slots=1 << 22)
    first = ["a cat, sat on one", "a cat sat off two,", "", "alone", " led", "a  b"]
    assert known.texts_ids(first) == plain(first)
    assert not known.table
    again = ["a cat, on three"]
    assert known.texts_ids(again) == plain(again)
    assert {"cat,", "on"} <= set(known.table) and "three" not in known.table
    assert known.texts_ids(again) == plain(again)


def test_table_and_encodings_are_bounded():
    letters = Letters()
    known = WordIds(letters, most=50, slots=1 << 8)
    for i in range(20):
        texts = [" ".join(["x", *(f"w{i // 2 * 300 + j}" for j in range(300))]), "x y, z"]
        assert known.texts_ids(texts) == plain(texts)
        assert len(known.table) <= 50 + 302 and known.marked <= known.slots
    many = ["x " + " ".join(f"n{j}" for j in range(5_000))]
    assert known.texts_ids(many) == plain(many) and letters.largest <= 2_000


def test_freed_memory_goes_back():
    code = """
import re
from reviewlens.llm.common import give_back
anon = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) / 1024
give_back()
base = anon()
blocks = [bytearray(8_000) for _ in range(20_000)]
last = bytearray(8_000)          # above the freed blocks
del blocks
give_back()
assert anon() - base < 40, (base, anon())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2], timeout=120)
