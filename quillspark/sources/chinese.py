"""Chinese segmentation: the most probable path over a dictionary's word graph, with an optional hidden Markov model for unknown words."""

from __future__ import annotations

import math
import re
from statistics import median

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import EngineError

# The Han blocks (and the ideographic zero) of the policy.
HAN = ((0x3007, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x2EBF0, 0x2EE5F), (0x2F800, 0x2FA1F), (0x30000, 0x3134F), (0x31350, 0x323AF))
_RUN = re.compile("[A-Za-z0-9]+|[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in HAN) + "]+")
LEAST = -3.14e100


class Segmenter:
    """Built from dictionary lines (``word freq tag``), user lines (``word``, ``word tag`` or ``word freq tag``) and, optionally, a model's nine lines."""

    def __init__(self, dictionary: list[str], user: list[str] = (), model: list[str] | None = None):
        counts = self._parse(dictionary, False)
        total = sum(counts.values())
        self.weight = {w: math.log(n / total) for w, n in counts.items()}
        middle = median(self.weight.values()) if self.weight else 0.0
        self.user = set()
        for word, n in self._parse(user, True).items():
            self.weight[word] = math.log(n / total) if n else middle
            self.user.add(word)
        self.least = min(self.weight.values(), default=0.0)
        self.longest = max(map(len, self.weight), default=1)
        self.model = self._model(model) if model is not None else None

    @staticmethod
    def _parse(lines: list[str], user: bool) -> dict[str, int]:
        out: dict[str, int] = {}
        for k, line in enumerate(lines):
            parts = line.removeprefix(chr(0xFEFF)).split()
            if not parts:
                continue
            context = "cppjieba.user_dictionary" if user else "cppjieba.dictionary"
            if (not user and len(parts) != 3) or len(parts) > 3 or parts[0] in out or len(parts[0]) > 512:
                raise EngineError(context, f"line {k + 1}")
            n = parts[1] if len(parts) == 3 else "0"
            if not n.isdigit() or (len(parts) == 3 and not 1 <= int(n) < 2**31):
                raise EngineError(context, f"line {k + 1}: frequency")
            out[parts[0]] = int(n)
        return out

    @staticmethod
    def _model(lines: list[str]) -> tuple[list[float], list[list[float]], list[dict[str, float]]]:
        rows = [x for x in (line.strip() for line in lines) if x and not x.startswith("#")]
        if len(rows) != 9:
            raise EngineError("cppjieba.hmm_model", "a model has nine lines")
        start, *trans = [[float(x) for x in r.split()] for r in rows[:5]]
        emit = [{p.rpartition(":")[0]: float(p.rpartition(":")[2]) for p in r.split(",")} for r in rows[5:]]
        if any(len(r) != 4 for r in (start, *trans)):
            raise EngineError("cppjieba.hmm_model", "four states")
        return start, trans, emit

    def _viterbi(self, run: str) -> list[str]:
        """Words by begin, end, middle and single states."""
        start, trans, emit = self.model
        score = [start[s] + emit[s].get(run[0], LEAST) for s in range(4)]
        back = []
        for c in run[1:]:
            step = [max(range(4), key=lambda p, s=s: score[p] + trans[p][s]) for s in range(4)]
            score = [score[step[s]] + trans[step[s]][s] + emit[s].get(c, LEAST) for s in range(4)]
            back.append(step)
        state = max((1, 3), key=lambda s: score[s])
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        words, begin = [], 0
        for k, s in enumerate(reversed(states)):
            if s in (1, 3):
                words.append(run[begin : k + 1])
                begin = k + 1
        return words if begin == len(run) else [*words, run[begin:]]

    def cut(self, run: str) -> list[str]:
        """The words of a run of Han characters; together they are the run."""
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, 0)] * (n + 1)
        for a in range(n - 1, -1, -1):
            single = (self.weight.get(run[a], self.least) + best[a + 1][0], a + 1)
            found = single
            for b in range(a + 2, min(n, a + self.longest) + 1):
                w = self.weight.get(run[a:b])
                if w is not None and w + best[b][0] > found[0]:
                    found = (w + best[b][0], b)
            best[a] = found
        words, a = [], 0
        while a < n:
            words.append(run[a : best[a][1]])
            a = best[a][1]
        if self.model is None:
            return words
        out: list[str] = []
        loose = ""
        for w in [*words, ""]:
            if len(w) == 1 and w not in self.user:
                loose += w
                continue
            if loose:
                out += self._viterbi(loose) if len(loose) > 1 else [loose]
                loose = ""
            if w:
                out.append(w)
        return out

    def tokens(self, text: str) -> list[str]:
        """ASCII letter and digit runs as they are, Han runs cut; anything else separates."""
        out: list[str] = []
        for m in _RUN.findall(text):
            out += [m] if m[0].isascii() else self.cut(m)
        return out


def chinese_tokenizer(segmenter: Segmenter):
    """A tokenizer (text column to array of strings) for ``quillspark.operators.terms``; the dictionary travels with the function."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(text: pd.Series) -> pd.Series:
        return pd.Series([segmenter.tokens(t or "") for t in text])

    def tokenize(c: Column) -> Column:
        return cut(c)

    return tokenize
