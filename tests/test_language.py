"""The boolean grammar against a naive model, and the edge cases it is known for."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.plans.query_language import Leaf, Node, denotation, leaf, leaves, postfix

UNIVERSE = frozenset(range(8))
SETS = {"a": {1, 2, 3}, "b": {2, 3, 4}, "c": {5}}


def meaning(node):
    if isinstance(node, Leaf):
        return frozenset().union(*(SETS.get(t, ()) for t in node.texts))
    parts = [meaning(p) for p in node.parts]
    return UNIVERSE - parts[0] if node.op == "NOT" else parts[0] & parts[1] if node.op == "AND" else parts[0] | parts[1]


def naive(tokens):
    """Well-formed expressions by recursive descent, OR below AND below NOT."""
    at = [0]

    def peek():
        return tokens[at[0]] if at[0] < len(tokens) else None

    def take():
        at[0] += 1
        return tokens[at[0] - 1]

    def unary():
        if peek() == "NOT":
            take()
            return UNIVERSE - unary()
        if peek() == "(":
            take()
            value = either()
            take()
            return value
        return frozenset(SETS.get(take(), ()))

    def both():
        value = unary()
        while peek() == "AND":
            take()
            value &= unary()
        return value

    def either():
        value = both()
        while peek() == "OR":
            take()
            value |= both()
        return value

    return either()


expressions = st.recursive(
    st.sampled_from(["a", "b", "c", "d"]).map(lambda w: [w]),
    lambda inner: st.one_of(inner.map(lambda x: ["NOT", *x]), inner.map(lambda x: ["(", *x, ")"]), st.tuples(inner, st.sampled_from(["AND", "OR"]), inner).map(lambda t: ["(", *t[0], ")", t[1], *t[2]])),
    max_leaves=8,
)


@settings(max_examples=300, deadline=None)
@given(expressions)
def test_well_formed_queries(tokens):
    # NOT takes what follows it, operators included, only up to its operand, in both readings.
    assert meaning(denotation(" ".join(tokens))) == naive(tokens)


def test_edge_cases():
    docs = lambda q: set(meaning(denotation(q)))
    assert docs("a b") == docs("a b AND c") == docs("a AND b c") == SETS["a"]
    assert docs("AND a") == docs("a AND") == docs("NOT") == docs("") == set()
    assert docs("NOT NOT a") == SETS["a"]
    assert docs("NOT a AND b") == {4}
    assert docs("a OR b AND c") == SETS["a"]
    assert docs("(a AND b") == {2, 3}
    assert docs("c OR (a AND b") == {5}
    assert docs("a) OR b") == {1, 2, 3, 4}
    assert docs("a OR b) AND c") == set() and docs("c OR b) AND c") == {5}
    assert docs("NOT ) a") == docs('"" OR a') == docs('NOT ""') == set() and docs("#2() OR a") == SETS["a"]
    assert docs('"" a') == SETS["a"]
    assert docs("a or b") == docs("a Or b") == {1, 2, 3, 4}
    assert docs('"a') == SETS["a"]


def test_leaves():
    assert leaf('"x y"') == Leaf("phrase", ("x y",))
    assert leaf("#5(a,b,c)") == Leaf("near", ("a", "b,c"), 5)
    assert leaf("#5(a b)") == leaf("#5") == leaf("(") or leaf("#5").texts == ()
    assert leaf("#٥(a,b)").distance == 5
    assert postfix("a AND NOT b") == ["a", "b", "NOT", "AND"]
    node = denotation("#2(a,b) AND a OR #2(a,b)")
    assert isinstance(node, Node) and leaves(node) == [Leaf("near", ("a", "b"), 2), Leaf("terms", ("a",))]
