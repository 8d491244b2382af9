import random
import uuid

import pytest

from scriptorium.llm.components import components


def plain(links):
    """ids -> least id of their component, but for the least ones."""
    near = {}
    for a, b in links:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for i in sorted(near):
        if i in out:
            continue
        out[i], queue = i, [i]
        while queue:
            for j in near[queue.pop()] - out.keys():
                out[j] = i
                queue.append(j)
    return {i: least for i, least in out.items() if i != least}


@pytest.mark.parametrize("most_links", [0, 300, 1_000_000])
def test_one_task_and_rounds_agree(spark, most_links):
    rng = random.Random(8)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(700)]
    links = [tuple(rng.sample(ids[:300], 2)) for _ in range(150)]  # small components
    links += zip(ids[300:450], ids[301:451], strict=True)  # a chain
    links += [(ids[500], i) for i in ids[501:]]  # a star
    links += [(ids[0], ids[0]), (ids[699], None), (None, ids[3]), *links[:50], *((b, a) for a, b in links[50:90])]
    for some in (links, [], [(None, 1), (4, 4)]):
        found = components(spark.createDataFrame(some, "a bigint, b bigint").repartition(5), most_links=most_links).collect()
        assert len(found) == len({r.id for r in found}) and {r.id: r.component_id for r in found} == plain(some)


def test_few_links_take_few_jobs(spark):
    """Exchanges of a few links leave files by the thousand; a chain once took rounds of eight of them."""
    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint")
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    try:
        assert components(links).count() == 200
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup(group)) <= 10
