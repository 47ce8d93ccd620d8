"""Named entities by an outside model, as matches beside those of patterns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame

from .categories import ALL, BY_CODE
from .spans import MATCH

#: Categories by a model's labels.
LABELS = {
    "persName": "imiona_nazwiska", "PERSON": "imiona_nazwiska", "PER": "imiona_nazwiska", "orgName": "firmy_instytucje", "ORG": "firmy_instytucje",
    "placeName": "miasta", "GPE": "miasta", "LOC": "miasta",
}
#: A worker's models, by the call that they were loaded for.
_LOADED: dict[str, Callable] = {}


def model_of(name: str, load: Callable[[], Callable]) -> Callable:
    """The worker's own model: looked up by the module, so that later tasks of the process find it."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]



def with_entities(df: DataFrame, load: Callable[[], Callable[[str], Iterable[tuple[int, int, str]]]], labels: dict[str, str] = LABELS) -> DataFrame:
    """df (text, ...) with extra: the matches that a model finds, for plans.api and spans.detect.

    load returns a model, a function from a text to (start, end, label) by code points; it is called once in each worker process.
    Labels that aren't named are left out. A null text has no matches. Where df has extra already, its matches stay.
    """
    columns, at = df.columns, df.columns.index("text")
    keep = [c for c in columns if c != "extra"]
    name = uuid.uuid4().hex

    def run(batches):
        model = model_of(name, load)
        for pdf in batches:
            out = []
            for text, had in zip(pdf.iloc[:, at], pdf["extra"] if "extra" in columns else [None] * len(pdf)):
                found = [] if had is None else [dict(m.asDict() if hasattr(m, "asDict") else m) for m in had]
                for start, end, label in model(text) if text is not None else ():
                    if (code := labels.get(label)) and end > start:
                        found.append({"start": start, "prio": BY_CODE[code].priority, "less": start - end, "ord": ALL.index(code), "category": code, "value": text[start:end]})
                out.append(found)
            yield pdf[keep].assign(extra=pd.Series(out, index=pdf.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "extra")
    return df.mapInPandas(run, f"{fields}, extra {MATCH}")
