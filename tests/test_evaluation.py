import random

from vigil.operators.evaluation import match_findings
from vigil.operators.graph import connected

DETECTIONS = "code string, finding_id string, refs array<string>, text string"
TRUTH = "code string, truth_id string, truth_order bigint, evidence_ids array<string>"


def in_turn(detections, truth):
    """Findings in id order, each with the first free anomaly: a shared evidence id before one named in the text."""
    taken, out = set(), set()
    for code, det, refs, text in sorted(detections, key=lambda d: d[1]):
        words = set(text.split())
        options = []
        for c, gt, order, ids in truth:
            if c == code and (set(ids) & set(refs) or set(ids) & words):
                options.append((0 if set(ids) & set(refs) else 1, order, gt))
        for _, _, gt in sorted(options):
            if (code, gt) not in taken:
                taken.add((code, gt))
                out.add((code, det, gt))
                break
    return out


def matches(spark, detections, truth):
    got = match_findings(spark.createDataFrame(detections, DETECTIONS), spark.createDataFrame(truth, TRUTH)).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_a_long_chain_of_findings_that_wait_for_each_other(spark):
    n = 300
    detections = [("C", f"d{i:04d}", [f"e{max(i - 1, 0)}", f"e{i}"], "") for i in range(n)]
    truth = [("C", f"g{i}", i, [f"e{i}"]) for i in range(n)]
    assert matches(spark, detections, truth) == {("C", f"d{i:04d}", f"g{i}") for i in range(n)}


def test_matches_are_those_of_findings_in_turn(spark):
    rng = random.Random(2)
    for seed in range(3):
        ids = [f"id{i}" for i in range(40 + 200 * seed)]
        detections = [(rng.choice("XY"), f"f{i:03d}", rng.sample(ids, rng.randint(0, 3)), " ".join(rng.sample(ids, 2))) for i in range(120)]
        truth = [(rng.choice("XY"), f"t{i}", rng.randrange(50), rng.sample(ids, rng.randint(0, 4))) for i in range(90)]
        assert matches(spark, detections, truth) == in_turn(detections, truth)
    assert matches(spark, [("X", "f", ["a"], "a")], [("X", "t", 0, ["b"]), ("Y", "u", 0, ["a"])]) == set()


def test_components(spark):
    rng = random.Random(6)
    edges = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(200)]
    edges += [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(140)] + [("hub", f"n{i}") for i in range(0, 300, 7)]
    edges += [("z", "z"), ("a", None), edges[0], edges[1][::-1]]
    near = {}
    for a, b in edges:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        todo = [node] if node not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = node
                todo += near[x]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want
    assert connected(spark.createDataFrame([], "a string, b string")).count() == 0
