"""Owned spans against a plain walk with a stack."""

import random

import pytest

from lodeweave.sources import spans

LINES = "key long, line int, step int, owns boolean, name string"


def plain(rows, most):
    out = []
    for key in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == key)
        stack, owner, ends = [(0, True, None)], {}, {}
        for _, line, step, owns, name in own:
            if step == 1:
                stack.append((line, owns, name))
            step = 0 if step == -1 and len(stack) == 1 else step
            holder = [x for x in stack if x[1]][-1]
            owner[line] = holder
            ends[line] = (step == 0 and stack[-1][1]) or (step == -1 and not stack[-1][1] and stack[-2][1])
            if step == -1:
                stack.pop()
        stretches, n = [], len(own)
        for line in range(1, n + 1):
            if line > 1 and owner[line][0] == owner[line - 1][0]:
                stretches[-1][1] = line
            else:
                stretches.append([line, line])
        found = []
        for a, b in stretches:
            while a <= b:
                may = [x for x in range(a, b + 1) if ends[x] or x == b]
                fit = [x for x in may if x < a + most]
                stop = max(fit) if fit else min(may)
                found.append((key, owner[a][0], owner[a][2], a, stop, stop - a + 1 > most))
                a = stop + 1
        for x in found:
            mine = [y for y in found if y[1] == x[1]]
            out.append((*x[:5], mine.index(x) + 1, len(mine), x[5]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, most", [(1, 3), (2, 1), (3, 7)])
def test_owned_spans(spark, seed, most):
    rng = random.Random(seed)
    rows = []
    for key in range(40):
        depth = 0
        for line in range(1, rng.randint(1, 60) + 1):
            step = rng.choice([0, 0, 0, 1, -1] if depth < 5 else [0, 0, -1])
            depth = max(0, depth + step)
            rows.append((key, line, step, rng.random() < 0.5, rng.choice("ab")))
    got = spans.owned_spans(spark.createDataFrame(rows, LINES).repartition(3), "key", most).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, most)
    assert {r["oversized"] for r in got} == {True, False}


def test_whole_lines_once(spark):
    html = "<html><body><ul><li>a<li>b</li></ul></body><p>x</div>"
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "plain")], "page_id long, html string")
    lines = spans.page_lines(pages, "page_id")
    got = spans.owned_spans(lines, "page_id", 2).collect()
    covered = sorted((r["page_id"], x) for r in got for x in range(r["start_line"], r["end_line"] + 1))
    assert covered == sorted((r["page_id"], r["line"]) for r in lines.collect()) and len(set(covered)) == len(covered)
    assert {r["page_id"] for r in got} == {1, 4}
