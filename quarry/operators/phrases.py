"""Key phrases of texts: what stands between stop words, scored by the words' company."""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A text is read as words (letters and digits of any script) and single other characters.
WORD = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Words that end a phrase, of the languages of the texts.
STOP = (
    "a an and are as at be but by for from had has have he her his i in into is it its not of on or our she so that the their them then there these they this those to was we were which who will with would you your "
    "al como con de del el en es esta la las lo los más no para pero por que se sin su sus un una y "
    "au aux avec ce ces dans des du elle est et il ils je le les leur mais ne nous on ou pas plus pour qui sa ses son sur une vous "
    "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er ich im ist mit nach nicht oder sich sie sind so und uns von vor war wie wir zu zum zur"
).split()


@F.pandas_udf(T.ArrayType(T.StructType().add("phrase", "string").add("score", "long")))
def _best(texts: pd.Series, most: pd.Series, longer_than: pd.Series) -> pd.Series:
    """The best phrases of texts that are given as their words, null where a phrase ends."""

    def one(words, most: int, longer_than: int) -> list[dict]:
        runs = [tuple(r) for ends, r in groupby(words, lambda w: w is None) if not ends]
        freq, degree = Counter(), Counter()
        for r in runs:
            for w in r:
                freq[w] += 1
                degree[w] += len(r)
        weight = {w: degree[w] * 1_000_000 // n for w, n in freq.items()}
        scored = ((" ".join(r), sum(weight[w] for w in r)) for r in set(runs))
        best = heapq.nsmallest(most, ((-score, phrase.encode(), phrase) for phrase, score in scored if len(phrase) > longer_than))
        return [{"phrase": phrase, "score": -less} for less, _, phrase in best]

    return pd.Series([one(*x) for x in zip(texts, most, longer_than, strict=True)])


def key_phrases(rows: DataFrame, key: str, text: Column, most: int = 20, longer_than: int = 3) -> DataFrame:
    """key, phrase, score: the `most` best lower-cased phrases of each text that are longer than `longer_than` characters.

    A phrase is a run of words without a stop word or other character between. A word's degree is the summed length of the
    runs that it stands in; a phrase's score adds up degree over frequency of its words, in whole millionths. Ties go by the
    phrase. Keys are unique and not null; a text is read in its own row, so nothing is moved."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    words = F.transform(tokens, lambda t: F.when(t.rlike(f"^{WORD}$") & ~t.isin(STOP), t))
    found = rows.where(F.col(key).isNotNull()).select(key, _best(words, F.lit(most), F.lit(longer_than)).alias("found"))
    return found.select(key, F.inline("found"))
