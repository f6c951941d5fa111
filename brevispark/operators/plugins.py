"""Plug-in points for models that run outside Spark: compressors, tokenizers and language models.

A plug-in is a factory that runs once per worker and returns a function of one row's values. Rows travel in Arrow batches. A row
with a null input has a null result. A row that fails has null results and its reason in `error`; one bad row does not end a run,
and no failure looks like an empty answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType


def plugged(df: DataFrame, make: Callable, inputs: Sequence[str], outputs: str, call: Callable) -> DataFrame:
    """df with the columns `outputs` (a schema) and `error`. call(model, *inputs) returns a tuple of the outputs."""
    added = StructType.fromDDL(outputs).fields
    schema = StructType([*df.schema.fields, *added, StructField("error", StringType())])
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            rows, errors = [], []
            for values in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs)):
                found, error = (None,) * len(added), None
                if None not in values:
                    try:
                        found = call(model, *values)
                    except Exception as e:  # noqa: BLE001  the reason goes to the row
                        error = f"{type(e).__name__}: {e}"
                rows.append(found)
                errors.append(error)
            columns = zip(*rows) if rows else [()] * len(added)
            made = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array(errors, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def count_tokens_with(df: DataFrame, make: Callable[[], Callable[[str], int]], text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Adds the number of a model's tokens of each text. make returns text -> number, as from a tokenizer's file."""
    return plugged(df, make, (text,), f"`{name}` bigint", lambda count, t: (int(count(t)),))


def tokenizer_file(path: str) -> Callable[[], Callable[[str], int]]:
    """A counter from a tokenizer's file: a `tokenizers` JSON file or a `sentencepiece` model. The file must exist on the workers."""
    def make():
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda t: len(model.encode(t))
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return lambda t: len(model.encode(t, add_special_tokens=False).ids)

    return make


GENERATED = "output string, n_input int, n_output int, prefill_s double, decode_s double, total_s double, is_cut int"


def generate_with(df: DataFrame, make: Callable[[], Callable[[str, int], dict]], prompt: str = "prompt", most_tokens: int = 32) -> DataFrame:
    """Adds a language model's answer to each prompt. make returns (prompt, most new tokens) -> dict of output, n_input, n_output and
    the times prefill_s, decode_s, total_s (missing ones are null). Outputs are trimmed; is_cut is 1 where all tokens were used."""
    def call(model, text):
        got = model(text, most_tokens)
        n = got.get("n_output")
        output = got.get("output")
        return (None if output is None else output.strip(), got.get("n_input"), n, *(got.get(k) for k in ("prefill_s", "decode_s", "total_s")), int(n is not None and n >= most_tokens))

    return plugged(df, make, (prompt,), GENERATED, call)
