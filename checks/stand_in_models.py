"""Model functions that leave some prompts unanswered or answer them unreadably."""

import pandas as pd

from checks.rule_model import rule_model
from siltlog.plans.model import TOKEN_COLUMNS


def _replies(requests: pd.DataFrame, text_of, tokens: int) -> pd.DataFrame:
    """One frame made at once: with one prompt a call, each column added to it costs more than the answer."""
    pairs = zip(requests["system_prompt"], requests["user_prompt"])
    rows = [(system, prompt, text_of(prompt), tokens, tokens, tokens) for system, prompt in pairs]
    return pd.DataFrame(rows, requests.index, ["system_prompt", "user_prompt", "text", *TOKEN_COLUMNS])


def even_only(requests: pd.DataFrame) -> pd.DataFrame:
    """Answers only prompts of even length."""
    return _replies(requests, lambda p: str(len(p)) if p is not None and len(p) % 2 == 0 else "", 1)


def no_thirds(requests: pd.DataFrame) -> pd.DataFrame:
    """Answers only prompts not divisible by three in length."""
    return _replies(requests, lambda p: "backup" if p is None or len(p) % 3 != 0 else None, 2)


def _listed(prompt: str) -> str:
    """The part of a prompt that lists patterns."""
    for title in ("=== ERROR/WARNING PATTERNS BY TIME WINDOW ===", "=== ERROR PATTERNS ==="):
        if title in prompt:
            return prompt.split(title)[1].split("\n===")[0]
    return prompt


def garbled(requests: pd.DataFrame) -> pd.DataFrame:
    """The rule model, but batches that list a forbidden page are cut short and other
    batches that list a slow backend get no answer."""
    done = rule_model(requests)
    listed = requests["user_prompt"].map(_listed)
    cut, lost = listed.str.contains("forbidden by"), listed.str.contains("slow backend")
    text = done["text"].mask(cut, done["text"].str[:20]).mask(lost & ~cut, "")
    return done.assign(text=text)
