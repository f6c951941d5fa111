"""Few-shot prompts in five variants as arrays of segments, and the calibration of how much redundancy they carry.

A task brings question, demos (array of struct question, answer, paraphrase), extra demos and a paraphrase of the question.
Every segment has a label, an origin, a section, a separator in front and a text; the prompt is their concatenation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevispark.functions import arrays as A

from .words import CORE, REDUNDANT

VARIANTS = ("basis", "filler", "semantic", "instruction", "demonstration")
# The building blocks of the prompts, which must be these for equal lengths and texts.
INSTRUCTION = "Answer the question with the name of the entity only. Do not explain."
QUESTION, ANSWER, CUE, BLOCK, LINE = "Q: ", "A: ", "A:", "\n\n", "\n"
INSTRUCTION_POOL = (
    "Answer with the entity name only.",
    "Reply with the entity name and nothing else.",
    "State only the name of the entity, with no explanation.",
    "Give only the name of the entity as your answer, without any further text.",
    "Your reply should contain the name of the entity and no other words at all.",
    "Respond with the name of the entity by itself, leaving out any sentence that would surround it.",
    "Write down nothing but the name of the entity; explanations, full sentences and additional remarks are not wanted here.",
    "The expected answer is the bare name of the entity, so do not add a sentence, a reason, or any surrounding text to it.",
    "Keep the response to the entity name alone, since any explanation, restatement or additional sentence would not be part of the expected answer.",
)
FILLER_POOL = (
    "The tide rises and falls twice each day along most coastlines.",
    "The pull of the moon drives it, and to a smaller degree the pull of the sun.",
    "Harbour wardens keep tables that list the predicted height for every hour.",
    "Small boats time their departures by them.",
    "In shallow estuaries the water can drain far enough to expose wide banks of mud.",
    "These banks are then crossed on foot by people gathering shellfish.",
    "Mapmakers record the line reached by the mean high water and print it on their charts.",
    "That line, and not the visible edge of the water, marks the legal shore.",
    "Surveyors once measured it with poles and chains over many seasons.",
    "Today a network of gauges reports the level continuously.",
    "The long series is averaged over nineteen years, the period after which the lunar cycle repeats.",
    "Wind and air pressure shift the actual level away from the prediction.",
    "The tables therefore carry a warning that they describe an average sea.",
    "Sailors learn to read the difference from the colour of the water.",
)
MOST_FILLERS = 4
TARGET, BAND = 0.5, 0.075
CHECKED = 4

SEGMENT = "struct<label:string,origin:string,section:string,sep:string,text:string>"


def _segment(label: str | Column, origin: str, section: str, text: Column, sep: str | Column = BLOCK) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(column(label).alias("label"), F.lit(origin).alias("origin"), F.lit(section).alias("section"), column(sep).alias("sep"), text.alias("text"))


def _pool(texts: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, texts))


def _pairs(demos: Column, name: str, origin: str, picked: Column | None = None) -> Column:
    """Question and answer segments of demos; with `picked`, paraphrases after the questions whose number (from 1) is in it."""
    def of(d: Column, i: Column) -> Column:
        label = F.concat(F.lit(f"{name}_"), (i + 1).cast("string"))
        parts = [_segment(F.concat(label, F.lit("_question")), origin, "demonstration", F.concat(F.lit(QUESTION), d["question"]))]
        if picked is not None:
            more = F.when(F.array_contains(picked, i + 1) & d["paraphrase"].isNotNull(), F.concat(F.lit(QUESTION), d["paraphrase"]))
            parts.append(_segment(F.concat(F.lit("paraphrase_"), label), REDUNDANT, "demonstration", more, LINE))
        parts.append(_segment(F.concat(label, F.lit("_answer")), origin, "demonstration", F.concat(F.lit(ANSWER), d["answer"]), LINE))
        return F.array(*parts)

    return F.flatten(F.transform(demos, of))


def build(variant: str, units: Column | None = None, question: str = "question", demos: str = "demos", extra: str = "extra", paraphrase: str = "paraphrase") -> Column:
    """The segments of a prompt. units: array<int> of the chosen redundancy (pool places, demo numbers with 0 for the question,
    extra demos from 0, or the ordered pair of instructions)."""
    units = F.array().cast("array<int>") if units is None else units
    start = [_segment("instruction", CORE, "instruction", F.lit(INSTRUCTION), "")]
    end = [_segment("question", CORE, "question", F.concat(F.lit(QUESTION), F.col(question)))]
    middle = _pairs(F.col(demos), "demonstration", CORE, units if variant == "semantic" else None)
    before = after = None
    chosen = F.array_sort(units)
    if variant == "instruction":
        text = lambda i: F.element_at(_pool(INSTRUCTION_POOL), F.element_at(units, i) + 1)
        before = F.array(_segment("instruction_before", REDUNDANT, "instruction", text(1), LINE))
        after = F.array(_segment("instruction_after", REDUNDANT, "instruction", text(2)))
    elif variant == "filler":
        before = F.transform(chosen, lambda u, i: _segment(F.concat(F.lit("filler_"), u.cast("string")), REDUNDANT, "filler", F.element_at(_pool(FILLER_POOL), u + 1), F.when(i == 0, BLOCK).otherwise(" ")))
    elif variant == "demonstration":
        after = _pairs(F.transform(chosen, lambda u: F.element_at(F.col(extra), u + 1)), "extra", REDUNDANT)
    elif variant == "semantic":
        text = F.when(F.array_contains(units, 0), F.concat(F.lit(QUESTION), F.col(paraphrase)))
        end.append(_segment("paraphrase_question", REDUNDANT, "question", text, LINE))
    end.append(_segment("cue", CORE, "question", F.lit(CUE), LINE))
    parts = [F.array(*start), before, middle, after, F.array(*end)]
    return F.filter(F.concat(*[p.cast(f"array<{SEGMENT}>") for p in parts if p is not None]), lambda s: F.coalesce(s["text"], F.lit("")) != "")


def prompt_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: F.concat(s["sep"], s["text"])), "")


def numbered(segments: Column) -> Column:
    """Segments with their place, as `words.labelled_tokens` reads them."""
    return F.transform(segments, lambda s, i: F.struct(i.alias("ord"), *[s[f].alias(f) for f in ("label", "origin", "section", "sep", "text")]))


def offsets(segments: Column) -> Column:
    """Start and end (code points) of each segment in the prompt."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        a = (acc["at"] + F.length(s["sep"])).cast("int")
        b = (a + F.length(s["text"])).cast("int")
        return F.struct(b.alias("at"), F.array_append(acc["out"], F.struct(a.alias("start"), b.alias("end"))).alias("out"))

    return F.aggregate(segments, start, step)["out"]


def calibration(n: Column, n_base: Column, variant: Column) -> dict[str, Column]:
    """Ratio of added length to the base, its band flag and deviation; the base variant has ratio 0 and no band."""
    q = F.when(variant == "basis", 0.0).otherwise((n - n_base) / F.when(n_base != 0, n_base))
    of = lambda x: F.when(variant != "basis", x)
    return {"calibration": q, "in_band": of((F.abs(q - TARGET) <= BAND).cast("int")), "deviation": of(F.abs(q - TARGET))}


def candidates(variant: str, n_units: int) -> Column:
    """All choices of units as array<array<int>>: ordered pairs of instructions, up to four fillers, any subset otherwise."""
    if variant == "instruction":
        return A.ordered_pairs(n_units)
    return A.subsets(n_units, MOST_FILLERS if variant == "filler" else n_units)


def n_candidates(variant: str, n_units: int) -> int:
    if variant == "instruction":
        return n_units * (n_units - 1)
    return sum(math.comb(n_units, r) for r in range(1, (MOST_FILLERS if variant == "filler" else n_units) + 1))


def calibrate(bases: DataFrame, variant: str, lengths: list[int], base: str = "n_base") -> DataFrame:
    """The best choice of pool units for each base length: the four nearest to the target by summed length, then the least by
    (distance of the ratio, number of units, units). The choice depends on the base length alone, so it is made once for
    each distinct length, by a sort within the row, and joined back."""
    sizes = F.array(*map(F.lit, lengths))
    total = lambda units: F.aggregate(units, F.lit(0), lambda a, u: a + F.element_at(sizes, u + 1))
    spark = bases.sparkSession
    # choices of one summed length differ in number and units only: four of each length are enough
    all_ = spark.range(1).select(F.explode(candidates(variant, len(lengths))).alias("units")).withColumn("added", total(F.col("units")))
    alike = Window.partitionBy("added").orderBy(F.size("units"), "units")
    few = all_.withColumn("_rank", F.row_number().over(alike)).where(F.col("_rank") <= CHECKED)
    one = few.agg(F.collect_list(F.struct("added", "units")).alias("_all"))  # one row, of at most 1470 choices
    rows = bases.select(base).where(F.col(base) > 0).distinct().join(F.broadcast(one), F.lit(True))
    near = F.sort_array(F.transform("_all", lambda c: F.struct(F.abs(c["added"] - TARGET * F.col(base)).alias("off"), F.size(c["units"]).alias("n"), c["units"].alias("units"), c["added"].alias("added"))))
    exact = F.transform(F.slice(near, 1, CHECKED), lambda c: F.struct(F.abs(c["added"] / F.col(base) - TARGET).alias("off"), c["n"].alias("n"), c["units"].alias("units"), c["added"].alias("added")))
    best = rows.select(base, F.array_min(exact).alias("b")).select(base, "b.units", "b.added", (F.col("b.added") / F.col(base)).alias("ratio"))
    return bases.join(best, base)
