"""Connected components against a plain search, contracted in tasks and by steps over all of them."""

import random

import pytest

from listwright.llm import components


def least_reached(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {}
    for node in sorted(near):
        todo = [] if node in found else [node]
        while todo:
            at = todo.pop()
            if at not in found:
                found[at] = node
                todo += near[at]
    return found


def tables_written(monkeypatch):
    written, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, label: (written.append(label), write(df, label))[1])
    return written


@pytest.mark.parametrize("held", [components.HELD, 30, 0])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held)
    chance = random.Random(5)
    links = [(i, i + 1) for i in range(-40, 0)] + [(500, i) for i in range(501, 560)]
    links += [(chance.randint(1000, 1400), chance.randint(1000, 1400)) for _ in range(250)]
    links += [*links[:30], (7, 7), (None, 3), (3, None), (-(2**63), 2**63 - 1)]
    chance.shuffle(links)
    table = spark.createDataFrame(links, "a long, b long")
    got = components.components(table.repartition(5)).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == least_reached(links)
    assert components.components(table.limit(0)).count() == 0


def test_few_links_take_no_steps(spark, monkeypatch):
    """Each step over all tasks costs as many small tasks as a shuffle has parts, whatever little there is to do."""
    written = tables_written(monkeypatch)
    chain = [(i, i + 1) for i in range(2000)]
    random.Random(1).shuffle(chain)
    found = components.components(spark.createDataFrame(chain, "a long, b long").repartition(8))
    assert {r["root"] for r in found.collect()} == {0} and found.count() == 2001
    assert len(written) <= 2
