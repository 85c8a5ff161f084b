"""Line dedup by content: short runs of many words are repeats too."""

import re
from collections import defaultdict

import pytest

from loomtrace.llm import line_dedup

BLANKS = " \t\x0b\x0c\r"


def _cleaned(texts: dict, run: int = 3, most: int = 50) -> dict:
    """Cleaned texts by comparing every run of up to ``run`` lines with all earlier ones."""
    seen, gone = set(), defaultdict(set)
    for i in sorted(texts):
        spots = [(k, x.strip(BLANKS)) for k, x in enumerate(texts[i].split("\n")) if x.strip(BLANKS)]
        for a in range(len(spots)):
            for length in range(1, run + 1):
                part = spots[a : a + length]
                n = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for _, x in part)
                if len(part) == length and (length == run or n > most):
                    gram = tuple(x for _, x in part)
                    if gram in seen:
                        gone[i] |= {k for k, _ in part}
                    seen.add(gram)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


def _line(name: str, n: int) -> str:
    return " ".join(f"{name}{i}" for i in range(n))


def test_long_runs_of_one_and_two_lines_are_deleted(spark):
    long, half, edge = _line("a", 51), [_line("b", 30), _line("c", 30)], _line("e", 50)
    texts = {
        0: f"x\n{long}\ny", 1: f"p\n{long}\nq", 2: long, 3: "\n".join(half), 4: "r\n" + "\n\n".join(half) + "\ns", 5: half[0] + "\nt", 6: edge, 7: edge,
        8: f"u\nv\n{long}\nw\n{long}", 9: f"x\n{long}\ny\n{edge}",
    }
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert got == _cleaned(texts)
    assert got[1] == "p\nq" and got[2] == "" and got[4] == "r\n\ns" and got[5] == texts[5] and got[7] == edge and got[8] == "u\nv\nw" and got[9] == edge


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_long_runs_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["text"] or "" for r in line_dedup.drop_repeats(docs).collect()}
    assert got == _cleaned(texts) and got != _cleaned(texts, most=10**9)
