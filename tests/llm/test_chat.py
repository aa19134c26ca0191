import itertools
import random

from vigil.llm import chat as C

ROWS = "conv_id long, turn long, role string, text string, piece int, seq int"


def legal(states):
    return bool(states) and states[-1] in (C.USER, C.ASSISTANT) and all(b in C._AFTER[a] for a, b in zip([C.START, *states], states, strict=False))


def brute(roles):
    """The least cost over all sequences of repairs."""
    best = None
    for choice in itertools.product((1, 2, 3), (False, True), (0, 2, 3), repeat=len(roles)):
        out, cost, ok = [], 0, True
        for i, role in enumerate(roles):
            to, merges, put = choice[3 * i : 3 * i + 3]
            cost += 0 if to == role else C.NAME if role == C.START else C.RELABEL
            if put:
                out.append(put)
                cost += C.INSERT
            if merges:
                ok &= bool(out) and out[-1] == to and not put
                cost += C.MERGE
            else:
                out.append(to)
        if ok:
            for more, extra in (([], 0), ([C.USER], C.INSERT)):
                if legal(out + more) and (best is None or cost + extra < best):
                    best = cost + extra
    return best


def test_cost_against_brute_force():
    for n in (1, 2, 3):
        for roles in itertools.product(range(4), repeat=n):
            cost, done = C.repair(list(roles))
            assert cost == brute(list(roles)), roles
            assert len(done) == n


def parsed(text):
    out = []
    for part in text.split("<|im_start|>")[1:]:
        role, body = part.split("\n", 1)
        assert body.endswith("<|im_end|>\n")
        out.append((role, body[: -len("<|im_end|>\n")]))
    return out


def run(spark, rows, partitions=4):
    got = C.format_chats(spark.createDataFrame([(*r, 0, 0) for r in rows], ROWS), partitions=partitions).collect()
    assert len(got) == len(rows)
    out = {}
    for r in sorted(got, key=lambda r: r.seq):
        out.setdefault(r.conv_id if r.conv_id is not None else f"null{r.seq}", []).append(r)
    return out


def test_rendering(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "human", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "x"), (2, 1, "user", "y"), (2, 2, "assistant", None), (3, 5, "assistant", "a"), (4, None, None, "q"), (5, 0, "system", "only"), (None, 0, "user", "n1"), (None, 0, "user", "n2"), (6, 0, "user", ""), (6, 0, "user", "")]
    got = run(spark, rows)
    text = {k: "".join(r.piece for r in v) for k, v in got.items()}
    assert parsed(text[1]) == [("system", "s"), ("user", "u"), ("assistant", "a")]
    assert parsed(text[2]) == [("user", "x\n\ny"), ("assistant", "")]
    assert parsed(text[3]) == [("user", ""), ("assistant", "a")]
    assert parsed(text[4]) == [("user", "q")] and parsed(text[5]) == [("system", "only"), ("user", "")]
    assert sorted(text[k] for k in text if str(k).startswith("null")) == [f"<|im_start|>user\nn{i}<|im_end|>\n" for i in (1, 2)]
    assert parsed(text[6]) == [("user", "\n\n")]


def test_a_conversation_cut_into_partitions(spark, monkeypatch):
    rng = random.Random(5)
    roles = [rng.choice(["system", "user", "assistant", "odd"]) for _ in range(400)]
    rows = [(7, i, r, f"t{i}") for i, r in enumerate(roles)] + [(i, 0, "user", "x") for i in range(100, 130)]
    whole, _ = C.repair([C.role_state(r) for r in roles])
    for partitions, fan in ((1, 256), (9, 256), (9, 2), (30, 3)):
        monkeypatch.setattr(C, "FAN", fan)  # so that the tree of matrices has several levels
        got = run(spark, rows, partitions)[7]
        text = "".join(r.piece for r in got)
        states = [C.ROLES.index(r) + 1 for r, _ in parsed(text)]
        assert legal(states) and [r.turn for r in got] == list(range(400))
        cost = sum((C.NAME if C.role_state(was) == 0 else C.RELABEL) * (r.action.startswith("relabel")) + C.MERGE * r.action.endswith("merge") + C.INSERT * (r.empty_before is not None) for r, was in zip(got, roles, strict=True))
        assert cost == whole
    assert C.format_chats(spark.createDataFrame([], ROWS)).count() == 0


def test_matrices_compose():
    """A part's matrix is the product of its halves', and the states chosen between parts cost what the whole costs."""
    rng = random.Random(8)
    for _ in range(60):
        roles = [rng.randrange(4) for _ in range(rng.randint(2, 12))]
        cuts = sorted(rng.sample(range(1, len(roles)), rng.randint(1, min(3, len(roles) - 1))))
        parts = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)], strict=True)]
        matrices = [list(C.matrix(p)) for p in parts]
        whole = matrices[0]
        for m in matrices[1:]:
            whole = C.product(whole, m)
        assert [min(x, C._FAR) for x in C.matrix(roles)] == whole
        states = C.between(matrices, C.START, None)
        assert all(a[1] == b[0] for a, b in zip(states[:-1], states[1:], strict=True)) and states[0][0] == C.START
        assert sum(m[4 * a + b] for m, (a, b) in zip(matrices, states, strict=True)) + C.END[states[-1][1]] == C.repair(roles)[0]
