import itertools
import random

import pytest

from tallygrid.llm import linededup
from tests.llm.rows import ODD, documents


def brute(docs, least):
    """Every run of lines against every earlier run, by their texts."""
    lines = {}
    for i, text in docs:
        lines[i] = [(no, x.strip(" \t\n\x0b\x0c\r")) for no, x in enumerate((text or "").split("\n"))]
        lines[i] = [(no, x, len(x.split())) for no, x in lines[i] if x]
    seen, gone = set(), {}
    for i, _ in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        mine = lines[i]
        for start in range(len(mine)):
            for end in range(start + 1, len(mine) + 1):
                run = tuple(x for _, x, _ in mine[start:end])
                if sum(n for _, _, n in mine[start:end]) >= least:
                    if run in seen:
                        gone.setdefault(i, set()).update(no for no, _, _ in mine[start:end])
            for end in range(start + 1, len(mine) + 1):
                seen.add(tuple(x for _, x, _ in mine[start:end]))
    out = {}
    for i, text in docs:
        left = [x for no, x in enumerate((text or "").split("\n")) if no not in gone.get(i, ())]
        out[i] = None if text is None else "\n".join(left)
    return out


@pytest.mark.parametrize("seed, least", [(1, 4), (2, 7), (3, 1), (4, 12)])
def test_against_all_runs(spark, seed, least):
    draw = random.Random(seed)
    pool = [" ".join(f"p{k}{j}" for j in range(draw.randrange(1, 4))) for k in range(6)] + [""]
    docs = [(k, "\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 12)))) for k in range(40)]
    docs += [(40, None), (41, ""), (None, docs[3][1] + "\nzz")]
    got = linededup.remove_repeated_lines(documents(spark, docs), least).collect()
    assert {r.doc_id: r.text for r in got} == brute(docs, least)


def test_long_copies_and_a_line_everywhere(spark):
    """A run of many lines, found though blocks are doubled only up to the least number of words."""
    lines = [f"line number {k} of many" for k in range(300)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(["new start", *lines[20:], "new end"]))]
    docs += [(k, f"common line here\nown text {k}") for k in range(3, 60)]
    got = {r.doc_id: r.text for r in linededup.remove_repeated_lines(documents(spark, docs), 50).collect()}
    assert got[2] == "new start\nnew end"
    assert all(got[k] == t for k, t in docs if k != 2)


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    got = linededup.remove_repeated_lines(docs, 50)
    rows = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    wanted = {8: ODD[8][1], 9: "", 10: ODD[11][1]}
    assert got.columns == [*docs.columns, "_lines_gone", "_words_gone"]
    # Equal rows are one document; document 14 has a single run of 50 words.
    assert rows == sorted(((i, wanted.get(i, t)) for i, t in ODD), key=str)
    kept = linededup.drop_repeated_lines(docs, 50)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in ODD if i != 9)
    assert linededup.remove_repeated_lines(docs.limit(0), 50).count() == 0


def test_ranks_are_a_suffix_array(spark):
    """Ranks sort the blocks of two lines like the hashes of their lines."""
    docs = documents(spark, [(k, "\n".join(p)) for k, p in enumerate(itertools.product("abc", repeat=3))])
    letters = linededup.line_letters(docs)
    by_place = {(r._doc, r.pos): (r.a, r.b) for r in letters.collect()}
    blocks = [r for r in linededup.block_ranks(letters, 4).collect() if r.r1 is not None]
    blocks.sort(key=lambda r: r.r1)
    keys = [(by_place[r._doc, r.pos], by_place[r._doc, r.pos + 1]) for r in blocks]
    assert keys == sorted(keys)
    assert all((x.r1 == y.r1) == (p == q) for (x, p), (y, q) in itertools.pairwise(zip(blocks, keys, strict=True)))
