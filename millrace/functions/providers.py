"""Model providers: chat, embeddings and entailment behind small protocols, each with a deterministic offline stand-in.

Batch calls run where the rows are, as Arrow UDFs; a provider is built once per worker. Hosted providers are imported only when asked for.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.spec import model_name

# The labels of an entailment model, in its order.
NLI_LABELS = ("entailment", "neutral", "contradiction")
DIMENSIONS = 64


class ChatProvider(Protocol):
    def generate(self, prompt: str, system_prompt: str | None = None, max_tokens: int | None = None, response_format: dict | None = None) -> str: ...


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class EntailmentProvider(Protocol):
    def classify(self, premise: str, hypothesis: str) -> dict[str, float]: ...


class OfflineChat:
    """Answers from a hash of the prompt: samples for generation prompts, a plan for planning, levels for judging, a phrase otherwise."""

    def __init__(self, model: str = "offline", temperature: float = 0.7, top_p: float = 1.0, max_tokens: int | None = None):
        self.model, self.temperature, self.top_p, self.max_tokens = model, temperature, top_p, max_tokens
        self.calls = 0

    def generate(self, prompt: str, system_prompt: str | None = None, max_tokens: int | None = None, response_format: dict | None = None) -> str:
        self.calls += 1
        seed = hashlib.sha256(f"{self.calls}|{self.temperature}|{system_prompt}|{prompt}".encode()).hexdigest()
        if wanted := re.search(r"Evaluate these (\d+) generated samples", prompt):
            levels = [3 + int(seed[k % 64], 16) % 3 for k in range(int(wanted[1]))]
            samples = [{"sample_index": k, "justification": "offline", "quality_level": x} for k, x in enumerate(levels)]
            return json.dumps({"reasoning": "offline", "aggregate_quality_level": sum(levels) / max(1, len(levels)), "samples": samples})
        if wanted := re.search(r"Write (\d+) samples for it", prompt):
            return json.dumps({"samples": [{"content": f"sample {seed[:8]}-{k}"} for k in range(int(wanted[1]))]})
        return f"offline answer {seed[:12]}"


class HostedChat:
    """A chat model behind the public OpenAI client; needs that package and its key in the environment."""

    def __init__(self, model: str = "gpt-4o-mini", temperature: float = 0.7, top_p: float = 1.0, max_tokens: int | None = None):
        import openai

        self.client = openai.OpenAI()
        self.model, self.temperature, self.top_p, self.max_tokens = model, temperature, top_p, max_tokens

    def generate(self, prompt: str, system_prompt: str | None = None, max_tokens: int | None = None, response_format: dict | None = None) -> str:
        messages = ([{"role": "system", "content": system_prompt}] if system_prompt else []) + [{"role": "user", "content": prompt}]
        options = {"max_tokens": max_tokens or self.max_tokens, "response_format": response_format}
        answer = self.client.chat.completions.create(model=self.model, messages=messages, temperature=self.temperature, top_p=self.top_p, **{k: v for k, v in options.items() if v is not None})
        return answer.choices[0].message.content


class OfflineEmbedding:
    """Hashed character trigrams, signed, so that like texts have like vectors."""

    def __init__(self, model: str = "offline"):
        self.model = model

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), DIMENSIONS))
        for row, text in zip(out, texts, strict=True):
            padded = f"  {text} "
            for k in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[k : k + 3].encode(), digest_size=4).digest(), "little")
                row[h % DIMENSIONS] += 1 if h >> 31 else -1
        return out.tolist()


#: Texts and characters that one request to a hosted model holds at most; a longer text is a request of its own.
MOST_TEXTS, MOST_CHARACTERS = 96, 100_000


def in_requests(texts: list[str], ask: Callable[[list[str]], list]) -> list:
    """The answers for all texts, in order, by as many requests as the bounds make necessary."""
    out, part, size = [], [], 0
    for t in texts:
        if part and (len(part) == MOST_TEXTS or size + len(t) > MOST_CHARACTERS):
            out += ask(part)
            part, size = [], 0
        part.append(t)
        size += len(t)
    return out + (ask(part) if part else [])


class HostedEmbedding:
    def __init__(self, model: str):
        import openai

        self.client, self.model = openai.OpenAI(), model

    def embed(self, texts: list[str]) -> list[list[float]]:
        return in_requests(texts, lambda part: [d.embedding for d in self.client.embeddings.create(model=self.model, input=part).data])


class CohereEmbedding:
    def __init__(self, model: str):
        import cohere

        self.client, self.model = cohere.Client(), model

    def embed(self, texts: list[str]) -> list[list[float]]:
        return in_requests(texts, lambda part: self.client.embed(texts=part, model=self.model, input_type="search_document").embeddings)


def embedding_provider(name: str) -> EmbeddingProvider:
    """``provider/model``; the provider is openai where none is named."""
    provider, model = model_name(name)
    made = {"openai": HostedEmbedding, "cohere": CohereEmbedding, "offline": OfflineEmbedding}
    if provider not in made:
        raise ValueError(f"no embedding provider {provider!r}")
    return made[provider](model)


class OfflineEntailment:
    """Entailment grows with the share of the hypothesis's words that the premise has."""

    def classify(self, premise: str, hypothesis: str) -> dict[str, float]:
        p, h = set(premise.lower().split()), set(hypothesis.lower().split())
        share = len(p & h) / len(h) if h else 1.0
        logits = [4 * share - 2, 0.0, 2 - 4 * share]
        top = max(logits)
        e = [math.exp(x - top) for x in logits]
        return {name: x / sum(e) for name, x in zip(NLI_LABELS, e, strict=True)}


class HostedEntailment:
    def __init__(self, model: str = "MoritzLaurer/DeBERTa-v3-base-mnli"):
        import torch
        import transformers

        self.torch = torch
        self.tokenizer = transformers.AutoTokenizer.from_pretrained(model)
        self.model = transformers.AutoModelForSequenceClassification.from_pretrained(model)

    def classify(self, premise: str, hypothesis: str) -> dict[str, float]:
        with self.torch.no_grad():
            logits = self.model(**self.tokenizer(premise, hypothesis, truncation=True, return_tensors="pt")).logits[0]
        return dict(zip(NLI_LABELS, self.torch.softmax(logits, -1).tolist(), strict=True))


def as_percent(probabilities: dict[str, float]) -> dict[str, float]:
    return {k: round(v * 100, 1) for k, v in probabilities.items()}


def classify_batch(provider: EntailmentProvider, premises: list[str], hypotheses: list[str], percent: bool = True) -> list[dict[str, float]]:
    if len(premises) != len(hypotheses):
        raise ValueError("as many premises as hypotheses are needed")
    out = [provider.classify(p, h) for p, h in zip(premises, hypotheses, strict=True)]
    return [as_percent(x) for x in out] if percent else out


def prediction(provider: EntailmentProvider, premise: str, hypothesis: str) -> str:
    scores = provider.classify(premise, hypothesis)
    return max(scores, key=scores.get)


@functools.lru_cache(8)
def _embedder(name: str) -> EmbeddingProvider:
    return embedding_provider(name)


def embed_column(text: Column, name: str) -> Column:
    """The vector of each text; equal texts of a batch are embedded once."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        distinct = texts.fillna("").drop_duplicates()
        known = dict(zip(distinct, _embedder(name).embed(distinct.tolist()), strict=True))
        return texts.fillna("").map(known)

    return run(text)


def entailment_columns(premise: Column, hypothesis: Column, provider: type = OfflineEntailment) -> Column:
    """The probability that premise entails hypothesis."""

    @F.pandas_udf("double")
    def run(p: pd.Series, h: pd.Series) -> pd.Series:
        model = provider()
        return pd.Series([model.classify(a or "", b or "")["entailment"] for a, b in zip(p, h, strict=True)])

    return run(premise, hypothesis)
