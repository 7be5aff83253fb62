"""Values, mounts, dominators, methods and guards against plain recursion on small random programs."""

import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from routeloom.operators import blocks, mounts, values


def evaluated(ops, args, v, steps=0, seen=()):
    """The texts of a value by plain recursion."""
    if steps > 12 or v in seen or v not in ops:
        return ["{?}"]
    op, text = ops[v]
    seen = (*seen, v)
    below = lambda: [evaluated(ops, args, a, steps + 1, seen) for a in args.get(v, [])]
    held = lambda x: ["{?}"] if len(x) > 32 else x
    union = lambda xs: list(dict.fromkeys(itertools.chain(*xs)))

    def product(a, b):
        return ["{?}"] if len(a) * len(b) > 32 else list(dict.fromkeys(x + y for x in a for y in b))

    if op == "const":
        return [text]
    if op in ("concat", "path", "any", "result", "same"):
        parts = below()
        if not parts:
            return [""] if op == "path" else ["{?}"]
        if op == "same":
            return parts[0]
        if op in ("any", "result"):
            out = held(union(parts))
            return [x for x in out if x] if op == "result" and len(out) > 1 else out
        out = parts[0]
        for p in parts[1:]:
            out = product(product(out, ["/"]) if op == "path" else out, p)
        return out
    return ["{?}"]


def test_values_equal_plain_recursion(spark):
    r = random.Random(9)
    ops, args = {}, {}
    for program in range(12):
        base = program * 100
        for i in range(14):
            op = r.choice(["const", "const", "concat", "any", "any", "same", "result", "path", "call"])
            ops[base + i] = (op, r.choice(["", "a", "b/", "c"]))
            if op not in ("const", "call"):
                n = {"concat": 2, "same": 1}.get(op, r.randint(0, 3))
                later = (lambda i=i, base=base, program=program: base + (r.randrange(i + 1, 15) if program % 2 else r.randrange(14)))  # every other program has circles
                args[base + i] = [later() for _ in range(n)]
    for i in range(20):  # a chain that is too long, and one that is not
        ops[5000 + i], args[5000 + i] = ("same", ""), [5001 + i]
    ops[5020] = ("const", "end")
    frame = spark.createDataFrame([(i, *o) for i, o in ops.items()], "id long, op string, text string")
    uses = spark.createDataFrame([(i, at, a) for i, own in args.items() for at, a in enumerate(own)], "id long, at int, arg long")
    got = {x.id: x.texts for x in values.fold(frame, uses, frame.select("id")).collect()}
    assert {i: got[i] for i in ops} == {i: evaluated(ops, args, i) for i in ops}
    assert got[5007] == ["{?}"] and got[5008] == ["end"]


def test_mounts(spark):
    rows = [("top", None, "chi", None), ("api", "top", "chi", "/api/"), ("v1", "api", "chi", "/v1"), ("root", "v1", "chi", "/"), ("twice", "top", "chi", "/x"), ("twice", "api", "chi", "/y"),
            ("g", None, "gin", None), ("g1", "g", "gin", "/g"), ("g2", "g1", "gin", ""), ("e", None, "echo", None), ("e1", "e", "echo", "/e/"), ("m", None, "gorilla", None), ("m1", "m", "gorilla", "/m"),
            ("loop1", "loop2", "chi", "/l"), ("loop2", "loop1", "chi", "/m"), ("below", "loop1", "chi", "/n"), ("lost", "nowhere", "chi", "/n")]
    rows += [(f"d{i}", f"d{i - 1}" if i else None, "echo", f"/{i}" if i else None) for i in range(70)]
    tree = spark.createDataFrame(rows, "router string, parent string, framework string, pattern string")
    got = defaultdict(set)
    for x in mounts.prefixes(tree).collect():
        got[x.router].add(x.prefix)
    assert got["v1"] == {"/api/v1"} and got["root"] == {"/api/v1"} and got["twice"] == {"/x", "/api/y"} and got["top"] == {""}
    assert got["g2"] == {"/g"} and got["e1"] == {"/e/"} and got["d69"] == {"".join(f"/{i}" for i in range(1, 70))}
    assert not {"loop1", "loop2", "below", "lost"} & got.keys()
    routes = [("root", "/"), ("v1", "/"), ("v1", "/pets"), ("top", "/"), ("g2", "pets/"), ("g", ""), ("g1", ""), ("e1", "/pets"), ("m1", "/pets"), ("twice", "/p")]
    found = [x.path for x in mounts.mounted(spark.createDataFrame([(i, *x) for i, x in enumerate(routes)], "id int, router string, pattern string"), tree).orderBy("id", "path").collect()]
    assert found == ["/api/v1", "/api/v1", "/api/v1/pets", "/", "/g/pets/", "/", "/g", "/e//pets", "/m/pets", "/api/y/p", "/x/p"]


def reach(edges, start, without=None, decided=None):
    seen, todo = set(), [start]
    while todo:
        b = todo.pop()
        if b in seen or b == without:
            continue
        seen.add(b)
        todo += [d for at, d in edges.get(b, []) if decided is None or b not in decided or at == decided[b]]
    return seen


def functions(seed, n, most):
    r = random.Random(seed)
    out = {}
    for fn in range(n):
        size = r.randint(1, most)
        out[fn] = {b: [(at, r.randrange(size) if r.random() < 0.3 else min(size - 1, b + 1 + r.randrange(3))) for at in range(r.choice([1, 2, 2]))] for b in range(size - 1)} or {0: [(0, 0)]}
    return out


def test_dominators_equal_leaving_blocks_out(spark):
    program = functions(1, 12, 12) | {100: {b: [(0, b + 1), (1, min(150, b + 5))] for b in range(150)}}
    edges = spark.createDataFrame([(f, b, at, d) for f, own in program.items() for b, ways in own.items() for at, d in ways], "fn long, src long, at int, dst long")
    got = {tuple(x) for x in blocks.dominates(blocks.dominators(edges)).collect()}
    want = set()
    for f, own in program.items():
        live = reach(own, 0)
        for by in live:
            want |= {(f, b, by) for b in live - (reach(own, 0, by) if by else set())}
    assert got == want


def strongest(program, tests, calls, branches, checks, fn, method, depth=0):
    """The required guard of a function, by the definition."""
    if depth > 3:
        return None
    own = program[fn]
    live = reach(own, 0, None, {b: 0 if (m == method) == equal else 1 for b, m, equal in tests[fn]})
    ranked = lambda role: blocks.RANKS.index(role)

    def first(call, excluded):
        b0, at0, name0 = call[0], call[1], call[2]
        for b, at, name, guard, _, _, work, _ in calls[fn]:
            if work and guard is None and name != name0 and b in live - excluded:
                if (at < at0) if b == b0 else b0 and b in reach(own, 0, b0):
                    return False
        return True

    best = None
    for call in sorted(c for c in calls[fn] if c[0] in live):
        block, at, name, guard, role, callee, _, _ = call
        use = None
        if guard is not None:
            for b, tested, deny in sorted(x for x in branches[fn] if x[1] == name and x[0] in live):
                to = dict(own[b])
                if deny not in to or 1 - deny not in to:
                    continue
                denied, allowed = to[deny], to[1 - deny]
                ok = set() if allowed == denied else reach(own, allowed, denied)
                region = reach(own, denied)
                inside = [c for c in calls[fn] if c[0] in region]
                if region & ok or inside and not any(c[7] for c in inside) or any(c[6] and c[3] is None for c in inside) or not first(call, region):
                    continue
                also = [r for cb, r in checks[fn] if cb in live and any(d == denied for _, d in own.get(cb, []))]
                top = max([role, *also], key=ranked)
                use = max([use, (guard, top)], key=lambda u: ranked(u[1]) if u else -1)
        elif callee is not None:
            inner = strongest(program, tests, calls, branches, checks, callee, method, depth + 1)
            use = inner if inner and first(call, set()) else None
        if use and (best is None or ranked(use[1]) > ranked(best[1])):
            best = use
    return best


def test_methods_and_guards_equal_the_definition(spark):
    r = random.Random(3)
    program = functions(2, 40, 7)
    tests, calls, branches, checks = (defaultdict(list) for _ in range(4))
    for fn, own in program.items():
        for b in own:
            if len(own[b]) == 2 and r.random() < 0.25:
                tests[fn].append((b, r.choice(["GET", "POST"]), r.random() < 0.5))
        for i in range(r.randint(1, 4)):
            kind = r.choice(["guard", "guard", "work", "deny", "call"])
            b = 0 if kind == "guard" and r.random() < 0.7 else r.randrange(max(own) + 2)
            calls[fn].append((b, i, i, f"g{fn}{i}" if kind == "guard" else None, r.choice(blocks.RANKS[2:]) if kind == "guard" else None, r.randrange(40) if kind == "call" else None, kind == "work", kind == "deny"))
            if kind == "guard":
                branches[fn] += [(x, i, r.randrange(2)) for x in own if len(own[x]) == 2 and r.random() < 0.8]
        checks[fn] = [(b, "admin") for b in own if r.random() < 0.1]
    rows = lambda facts: [(fn, *x) for fn, own in facts.items() for x in own]
    edges = spark.createDataFrame([(f, b, at, d) for f, own in program.items() for b, ways in own.items() for at, d in ways], "fn long, src long, at int, dst long")
    t = spark.createDataFrame(rows(tests), "fn long, block long, method string, equal boolean")
    got = {(x.fn, x.method): (x.guard, x.role) for x in blocks.required(
        edges, t, spark.createDataFrame(rows(calls), "fn long, block long, at int, call long, guard string, role string, callee long, work boolean, denies boolean"),
        spark.createDataFrame(rows(branches), "fn long, block long, call long, deny int"), spark.createDataFrame(rows(checks), "fn long, block long, role string"), ("GET", "POST")).collect()}
    want = {(fn, m): u for fn in program for m in ("GET", "POST", "*") if (u := strongest(program, tests, calls, branches, checks, fn, m))}
    assert got == want and len(want) > 15

    scopes = defaultdict(set)
    for x in blocks.method_scopes(edges, t).collect():
        scopes[x.fn, x.block] = set(x.methods.split(","))
    for fn, own in program.items():
        if tests[fn]:
            for m in {x[1] for x in tests[fn]} | {"*"}:
                live = reach(own, 0, None, {b: 0 if (x == m) == equal else 1 for b, x, equal in tests[fn]})
                assert live == {b for (f, b), ms in scopes.items() if f == fn and m in ms}
        else:
            assert not any(f == fn for f, _ in scopes)
