"""Textbook evaluation of formulas, for comparison only."""

from itertools import product

from tracelogic.formula import ast


def satisfied(f, tps, facts, i, env):
    """Whether f holds at position i; tps: [ts], facts: [{(relation, args)}], env: name to value."""
    val = lambda t: env[t.name] if isinstance(t, ast.Var) else t.value
    go = lambda g, j=i, e=env: satisfied(g, tps, facts, j, e)
    n = len(tps)
    if isinstance(f, ast.Truth):
        return f.value
    if isinstance(f, ast.Pred):
        return (f.relation, tuple(map(val, f.args))) in facts[i]
    if isinstance(f, ast.Compare):
        return val(f.left) == val(f.right) if f.op == "=" else val(f.left) < val(f.right)
    if isinstance(f, ast.Not):
        return not go(f.arg)
    if isinstance(f, ast.And):
        return go(f.left) and go(f.right)
    if isinstance(f, ast.Or):
        return go(f.left) or go(f.right)
    if isinstance(f, (ast.Exists, ast.Forall)):
        return (any if isinstance(f, ast.Exists) else all)(go(f.arg, i, {**env, f.var: v}) for v in domain(facts))
    inside = lambda a, b: f.interval.lo <= tps[b] - tps[a] and (f.interval.hi is None or tps[b] - tps[a] < f.interval.hi)
    if isinstance(f, ast.Prev):
        return i > 0 and inside(i - 1, i) and go(f.arg, i - 1)
    if isinstance(f, ast.Next):
        return i + 1 < n and inside(i, i + 1) and go(f.arg, i + 1)
    if isinstance(f, ast.Once):
        return any(inside(j, i) and go(f.arg, j) for j in range(i + 1))
    if isinstance(f, ast.Eventually):
        return any(inside(i, j) and go(f.arg, j) for j in range(i, n))
    if isinstance(f, ast.Since):
        return any(inside(j, i) and go(f.right, j) and all(go(f.left, k) for k in range(j + 1, i + 1)) for j in range(i + 1))
    if isinstance(f, ast.Until):
        return any(inside(i, j) and go(f.right, j) and all(go(f.left, k) for k in range(i, j)) for j in range(i, n))
    if isinstance(f, ast.Trigger):
        return all(not inside(j, i) or go(f.right, j) or any(go(f.left, k) for k in range(j + 1, i + 1)) for j in range(i + 1))
    if isinstance(f, ast.Release):
        return all(not inside(i, j) or go(f.right, j) or any(go(f.left, k) for k in range(i, j)) for j in range(i, n))
    raise TypeError(f)


def domain(facts):
    return sorted({a for day in facts for _, args in day for a in args}, key=str)


def verdicts(f, tps, facts):
    free = ast.free_variables(f)
    return {(i, *vs) for i in range(len(tps)) for vs in product(domain(facts), repeat=len(free)) if satisfied(f, tps, facts, i, dict(zip(free, vs, strict=True)))}
