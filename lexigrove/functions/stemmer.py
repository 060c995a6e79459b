"""A root stemmer for Arabic without a root dictionary, after Taghva, Elkhoury and Coombs (ITCC 2005), in column expressions.

Marks go; a listed word stays; the longest listed prefix and suffix go where enough letters remain; of two waws in front one
goes, and a hamza on an initial alif. Then the word's length says which shapes are tried: in a shape ف ع ل stand for root letters
and every other letter for itself, and the first shape that fits gives the root. A word that none fits loses one letter, a listed
suffix or else a listed prefix, and is tried with the shapes of its new length; one that keeps its length is tried with the shapes
of roots of four letters. Words under four and over seven letters are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The paper's marks, words, affixes and shapes, in the order in which they are tried.
MARKS = "[ً-ْ]"
KEPT = (
    "يكون وليس وكان كذلك التي وبين عليها مساء الذي وكانت ولكن والتي تكون اليوم اللذين عليه كانت لذلك أمام هناك منها مازال لازال لايزال مايزال "
    "اصبح أصبح أمسى امسى أضحى اضحى مابرح مافتئ ماانفك لاسيما ولايزال الحالي اليها الذين فانه والذي وهذا لهذا فكان ستكون اليه يمكن بهذا الذى"
).split()
PREFIXES = {3: "كال بال ولل وال".split(), 2: "ال لل".split()}
SUFFIXES = {3: "تمل همل تان تين كمل".split(), 2: "ون ات ان ين تن كم هن نا يا ها تم كن ني وا ما هم".split()}
ONE_BEFORE = "ل ب ف س و ي ت ن ا".split()
ONE_AFTER = "ة ه ي ك ت ا ن".split()
HAMZAS, ALIF = "آأإ", "ا"
SHAPES = {
    4: "مفعل فاعل فعال فعول فعيل فعلة".split(),
    5: "افتعل افاعل مفعول مفعيل مفعال افعلة تفعلة مفعلة مفتعل يفتعل تفتعل مفاعل تفاعل فعالة فعولة انفعل منفعل افعال فعلان تفعيل فاعول فواعل فعائل فاعلة فعالي".split(),
    6: "استفعل مستفعل مفعالة افتعال افعوعل تفاعيل".split(),
}
#: Shapes of roots of four letters.
LONGER = {5: "افعلل تفعلل مفعلل فعللة فعالل".split(), 6: "افعلال متفعلل".split()}
ROOT = "فعل"


def _shape(word: Column, shape: str) -> tuple[Column, Column]:
    """(whether a word of the shape's length fits it, its root letters). A root letter that a shape shows twice in three must be the same."""
    at = lambda i: F.substring(word, i + 1, 1)
    places = [i for i, letter in enumerate(shape) if letter in ROOT]
    fits = F.lit(True)
    for i, letter in enumerate(shape):
        if letter not in ROOT:
            fits = fits & (at(i) == letter)
    if shape.count("ع") == 2:
        first, second = (i for i, letter in enumerate(shape) if letter == "ع")
        fits, places = fits & (at(first) == at(second)), [i for i in places if i != first]
    return fits, F.concat(*map(at, places))


def _fit(word: Column, shapes: list[str], otherwise: Column) -> Column:
    """The root letters of the first shape that fits."""
    out = None
    for shape in shapes:
        fits, root = _shape(word, shape)
        out = F.when(fits, root) if out is None else out.when(fits, root)
    return out.otherwise(otherwise)


def _without(word: Column, n: int, front: bool) -> Column:
    return F.substring(word, n + 1, 2**31 - 1) if front else F.left(word, F.length(word) - n)


def _cut(word: Column, affixes: dict[int, list[str]], front: bool) -> Column:
    """The longest listed affix off, if three letters remain."""
    end = lambda n: F.substring(word, 1, n) if front else F.right(word, F.lit(n))
    size = F.length(word)
    return F.when((size >= 6) & end(3).isin(affixes[3]), _without(word, 3, front)).when((size >= 5) & end(2).isin(affixes[2]), _without(word, 2, front)).otherwise(word)


def _shorter(word: Column) -> Column:
    """One listed letter off: the last, or else the first."""
    return F.when(F.right(word, F.lit(1)).isin(ONE_AFTER), _without(word, 1, False)).when(F.substring(word, 1, 1).isin(ONE_BEFORE), _without(word, 1, True)).otherwise(word)


def _then(state: Column, step: Callable[[Column], Column]) -> Column:
    """step(state), with state worked out once however often the step names it: plans grow by the steps, not by their uses."""
    return F.get(F.transform(F.array(state), step), F.lit(0))


def _at_length(n: int) -> Callable[[Column], Column]:
    """A step for words of n letters. One that keeps its length, as no shape and no affix took letters off, is done with."""

    def step(s: Column) -> Column:
        here = ~s["done"] & (F.length(s["w"]) == n)
        tried = F.struct(s["w"].alias("w"), s["done"].alias("done"), F.when(here, _fit(s["w"], SHAPES[n], _shorter(s["w"]))).otherwise(s["w"]).alias("to"), here.alias("here"))
        return _then(tried, after)

    def after(s: Column) -> Column:
        same = s["here"] & (F.length(s["to"]) == n)
        word = F.when(same, _fit(s["w"], LONGER[n], s["w"])).otherwise(s["to"]) if n in LONGER else s["to"]
        return F.struct(word.alias("w"), (s["done"] | same).alias("done"))

    return step


def _unless_done(cut: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.when(s["done"], s["w"]).otherwise(cut(s["w"])).alias("w"), s["done"].alias("done"))


STEPS: tuple[Callable[[Column], Column], ...] = (
    lambda s: F.struct(s["w"].alias("w"), s["w"].isin(KEPT).alias("done")),
    _unless_done(lambda w: _cut(w, PREFIXES, True)),
    _unless_done(lambda w: _cut(w, SUFFIXES, False)),
    _unless_done(lambda w: F.when((F.length(w) >= 4) & w.startswith("وو"), _without(w, 1, True)).otherwise(w)),
    _unless_done(lambda w: F.when(F.substring(w, 1, 1).isin(list(HAMZAS)), F.concat(F.lit(ALIF), _without(w, 1, True))).otherwise(w)),
    _unless_done(lambda w: F.when(F.length(w) == 7, _shorter(w)).otherwise(w)),
    _at_length(6),
    _at_length(5),
    _at_length(4),
)


def stem(c: Column) -> Column:
    """The root of a word, or what is left of it where no shape fits; null gives the empty string."""
    state = F.struct(F.regexp_replace(F.coalesce(c, F.lit("")), MARKS, "").alias("w"))
    for step in STEPS:
        state = _then(state, step)
    return state["w"]
