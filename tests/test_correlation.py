import math
import random
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from helpers import at

from vigil.operators import notes as nt
from vigil.operators.bursts import burst_edges, find_bursts

DAY = 86400


def greedy(rows, width, n_min, h_min):
    """Plain loop over one asset's (second, high) rows."""
    rows, out, i = sorted(rows), [], 0
    while i < len(rows):
        inside = [r for r in rows[i:] if r[0] - rows[i][0] <= width]
        if len(inside) >= n_min or sum(h for _, h in inside) >= h_min:
            out.append((rows[i][0], len(inside), sum(h for _, h in inside)))
            i += len(inside)
        else:
            i += 1
    return out


@pytest.mark.parametrize("fold_limit", [20_000, 10, 3, 0])
def test_bursts_match_a_plain_loop(make_events, fold_limit):
    rng = random.Random(11)
    start, rows, want = datetime(2026, 1, 1, 7), [], {}
    for a in range(40):
        span = rng.choice([1, 3, 10, 40]) * DAY
        ticks = [rng.randrange(0, span, rng.choice([1, 3600])) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.3:
            ticks += [t + DAY for t in ticks[:5]]  # exactly one window apart
        sample = [(t, rng.random() < 0.4) for t in ticks]
        want[f"S{a}"] = greedy(sample, DAY, 5, 3)
        rows += [
            dict(kind="ALERT", asset_id=f"S{a}", severity="HIGH" if h else "LOW", event_timestamp=start + timedelta(seconds=t))
            for t, h in sample
        ]
    clusters, members = find_bursts(make_events(*rows), fold_limit=fold_limit)
    got = defaultdict(list)
    for r in clusters.collect():
        second = int((r.time_window_start - start).total_seconds())
        got[r.asset_id].append((second, r.alert_count, r.high_critical_count))
    assert {a: sorted(v) for a, v in got.items()} == {a: v for a, v in want.items() if v}
    assert members.count() == sum(n for v in want.values() for _, n, _ in v)


def test_burst_edges_form_a_star(make_events):
    rows = [dict(kind="ALERT", asset_id=" SRV ", severity="HIGH", rule_id=f"R{i % 2}", event_timestamp=at(5) + timedelta(minutes=15 * i)) for i in range(6)]
    rows += [dict(kind="ALERT", asset_id=x, severity="HIGH", event_timestamp=at(5)) for x in ("None", "  ", None)]
    clusters, members = find_bursts(make_events(*rows))
    (cluster,) = clusters.collect()
    assert (cluster.asset_id, cluster.alert_count, cluster.distinct_rules) == ("SRV", 6, ["R0", "R1"])
    edges = burst_edges(clusters, members).collect()
    assert len(edges) == 5 and {e.primary_event_id for e in edges} == {"e000"}
    far = [dict(rows[0], severity="LOW"), dict(rows[0], severity="LOW", event_timestamp=at(35))]
    assert find_bursts(make_events(*far))[0].count() == 0


def brute_pairs(texts):
    """All similar pairs of one corpus by definition."""
    docs = [Counter(t.split()) for t in texts]
    n = len(docs)
    df = Counter(w for d in docs for w in d)
    vectors = []
    for d in docs:
        v = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in d.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
    out = set()
    for i in range(n):
        for j in range(i + 1, n):
            cosine = sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items())
            jac = len(docs[i].keys() & docs[j].keys()) / len(docs[i].keys() | docs[j].keys())
            if cosine >= 0.595 and (cosine >= 0.85 or jac >= 0.80):
                out.add((i, j))
    return out


def test_similar_notes_match_brute_force(make_events):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(40)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(10, 30))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    events = make_events(*[
        dict(kind="INVESTIGATION", case_id=f"C{i}", investigation_notes=t, event_timestamp=at(i)) for i, t in enumerate(texts)
    ])
    corpus = nt.note_corpus(events)
    members = defaultdict(list)
    for r in corpus.select("bag", "event_id").collect():
        members[r.bag].append(int(r.event_id[1:]))
    pairs = set()
    for bag, ids in members.items():
        pairs |= {(min(a, b), max(a, b)) for a in ids for b in ids if a != b}
    stands_for = 0
    for r in nt.similar_group_edges(corpus).collect():
        stands_for += r.pair_count
        pairs |= {(min(a, b), max(a, b)) for a in members[r.bag_a] for b in members[r.bag_b]}
    assert pairs == brute_pairs(texts)
    inside = sum(r.pair_count for r in nt.clone_groups(corpus).collect())
    assert stands_for + inside == len(pairs)


def random_notes(make_events, seed, count, vocabulary):
    rng = random.Random(seed)
    texts = [[f"word{rng.randrange(vocabulary)}" for _ in range(20)] for _ in range(count)]
    texts += [[*t[:-1], "other"] for t in texts[:5]]
    return nt.note_groups(nt.note_corpus(make_events(*[
        dict(kind="INVESTIGATION", case_id=f"C{i}", investigation_notes=" ".join(t), event_timestamp=at(i)) for i, t in enumerate(texts)
    ])))


@pytest.mark.parametrize("frequent", [200_000, 20, 0])
def test_weights_with_few_broadcast_terms(make_events, monkeypatch, frequent):
    monkeypatch.setattr(nt, "FREQUENT_TERMS", frequent)
    groups = random_notes(make_events, 3, 20, 60)
    bags = {r.bag: Counter(r.tokens) for r in groups.select("bag", "tokens").collect()}
    sizes = {r.bag: r["size"] for r in groups.select("bag", "size").collect()}
    df = Counter()
    for bag, words in bags.items():
        df.update({w: sizes[bag] for w in words})
    docs, expected = sum(sizes.values()), {}
    for bag, words in bags.items():
        raw = {w: n * (math.log((1 + docs) / (1 + df[w])) + 1) for w, n in words.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        expected.update({(bag, w): (df[w], pytest.approx(x / norm)) for w, x in raw.items()})
    assert {(r.bag, r.term): (r.df, r.w) for r in nt.term_weights(groups).collect()} == expected


def test_only_pairs_that_may_be_similar_are_compared(make_events):
    vectors = nt.term_vectors(random_notes(make_events, 4, 60, 60))
    v = {r.gid: {t.term: t.w for t in r.v} for r in vectors.collect()}  # rarest term first
    prefix = {}  # terms one of which every similar pair shares
    for g, terms in v.items():
        w = list(terms.values())
        prefix[g] = {t for i, t in enumerate(terms) if sum(x * x for x in w[i:]) >= 0.85**2 or len(w) - i >= 0.8 * len(w)}
    similar, meeting = set(), 0
    for a in v:
        for b in v:
            if a < b:
                common = v[a].keys() & v[b].keys()
                meeting += bool(prefix[a] & prefix[b])
                if sum(v[a][t] * v[b][t] for t in common) >= 0.85 or len(common) >= 0.8 * len(v[a].keys() | v[b].keys()):
                    similar.add((a, b))
    candidates = {(r.a, r.b) for r in nt.candidate_pairs(vectors, 0.85, 0.80).collect()}
    assert len(similar) >= 3 and similar <= candidates
    assert len(candidates) < meeting, (len(candidates), meeting)


@pytest.mark.parametrize("postings", [2_000_000, 300, 40])
def test_blocks_of_notes_lose_no_pair(make_events, monkeypatch, postings):
    monkeypatch.setattr(nt, "BLOCK_POSTINGS", postings)
    vectors = nt.term_vectors(random_notes(make_events, 5, 60, 60))
    v = {r.gid: {t.term: t.w for t in r.v} for r in vectors.collect()}
    similar = {
        (a, b) for a in v for b in v if a < b and (
            sum(v[a][t] * v[b][t] for t in v[a].keys() & v[b].keys()) >= 0.85
            or len(v[a].keys() & v[b].keys()) >= 0.8 * len(v[a].keys() | v[b].keys()))}
    found = nt.candidate_pairs(vectors, 0.85, 0.80)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and similar <= set(pairs) and len(similar) >= 3


@pytest.mark.parametrize("whole", [64_000_000, 1])
def test_blocks_that_cannot_be_similar_do_not_meet(make_events, monkeypatch, whole):
    monkeypatch.setattr(nt, "BLOCK_POSTINGS", 60)
    monkeypatch.setattr(nt, "ROUND_BYTES", whole)
    rng = random.Random(6)
    texts = [[f"word{i}" for i in rng.sample(range(300), n)] for n in [12] * 20 + [40] * 12 + [160] * 4]
    texts += [[*t[:-1], "other"] for t in (texts[0], texts[1], texts[20], texts[32])]
    vectors = nt.stored(nt.term_vectors(nt.note_groups(nt.note_corpus(make_events(*[
        dict(kind="INVESTIGATION", case_id=f"C{i}", investigation_notes=" ".join(t), event_timestamp=at(i)) for i, t in enumerate(texts)
    ])))), "vectors")
    rows = nt.in_blocks(nt.prefixes(vectors, 0.85, 0.80))
    n = rows.select("block").distinct().count()
    meeting = nt.block_pairs(rows, 0.80).collect()
    assert n >= 8 and len(meeting) < 0.8 * n * (n + 1) / 2
    v = {r.gid: {t.term: t.w for t in r.v} for r in vectors.collect()}
    similar = {
        (a, b) for a in v for b in v if a < b and (
            sum(v[a][t] * v[b][t] for t in v[a].keys() & v[b].keys()) >= 0.85
            or len(v[a].keys() & v[b].keys()) >= 0.8 * len(v[a].keys() | v[b].keys()))}
    pairs = [(r.a, r.b) for r in nt.candidate_pairs(vectors, 0.85, 0.80).collect()]
    assert len(pairs) == len(set(pairs)) and similar <= set(pairs) and len(similar) == 4


def test_what_was_shuffled_for_notes_does_not_stay_on_disk(spark, make_events, monkeypatch):
    monkeypatch.setattr(nt, "SLICED_POSTINGS", 0)  # all slices
    monkeypatch.setattr(nt, "FREQUENT_TERMS", 20)
    events = random_notes(make_events, 7, 40, 60)
    groups = nt.settled(events, "groups")
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {str(f.getName()) for f in iter_scala(files.getAllFiles()) if f.getName().startswith("shuffle_")}

    def iter_scala(found):
        return [found.apply(i) for i in range(found.size())]

    before = shuffled()
    counts = nt.term_counts(groups)
    for _ in range(50):  # files go in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert counts.count() == groups.count() == 45


def test_vectors_move_once_for_near_copies(make_events, monkeypatch):
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(words[:-1] + [f"other{i}"]) for i in range(12)]  # all pairs are similar
    groups = nt.note_groups(nt.note_corpus(make_events(*[
        dict(kind="INVESTIGATION", case_id=f"C{i}", investigation_notes=t, event_timestamp=at(i)) for i, t in enumerate(texts)
    ])))
    counts = nt.term_counts(groups)
    candidates = nt.stored(nt.candidate_pairs(nt.unit_vectors(counts), 0.85, 0.80), "candidates")
    rows, pairs = nt.dealt_pairs(counts, candidates)
    assert (rows.count(), pairs.count()) == (12, 66)
    whole = {(r.bag_a, r.bag_b): (r.cosine, r.jaccard, r.shared_tokens) for r in nt.similar_groups(groups).collect()}
    assert len(whole) == 66 and all(
        j == 59 / 61 and shown == sorted(words[:-1])[:15] for _, j, shown in whole.values())
    monkeypatch.setattr(nt, "LABEL_GROUPS", 3)
    cut = {(r.bag_a, r.bag_b): (pytest.approx(r.cosine), r.jaccard, r.shared_tokens) for r in nt.similar_groups(groups).collect()}
    assert whole == cut


def test_note_rules(make_events):
    text = "Reviewed endpoint telemetry, isolated workstation; reset credentials, notified manager, closed ticket as malicious phishing"
    rows = [dict(kind="INVESTIGATION", case_id=f"C{i}", investigation_notes=text, event_timestamp=at(i)) for i in range(2)]
    other = dict(kind="INVESTIGATION", case_id="C9", conclusion="Database backup failed because storage array rebuilt slowly during maintenance window overnight", event_timestamp=at(3))
    short = dict(kind="INVESTIGATION", case_id="C8", action_taken="closed without any further action", event_timestamp=at(3))
    (edge,) = nt.note_edges(make_events(*rows, other, short)).collect()
    assert (edge.primary_event_id, edge.correlated_event_id, edge.similarity_score) == ("e000", "e001", 1.0)
    same_case = [dict(r, case_id="C1") for r in rows]
    assert nt.note_edges(make_events(*same_case)).count() == 0
    assert nt.clone_groups(nt.note_corpus(make_events(*same_case))).count() == 0
