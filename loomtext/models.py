"""Model clients. A client is any object with ``complete(prompt, model) -> Completion``, or with the
coroutine ``acomplete`` of the same form.

One client is built per task from a picklable factory, so keys are read from the worker's environment
and never travel in a column. Usage comes back as columns, because a counter kept on an executor would
be lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

Prompt = str | list[dict]


@dataclass(frozen=True)
class Completion:
    response: str
    input_tokens: int | None = None
    output_tokens: int | None = None
    calls: int = 1


class Client(Protocol):
    def complete(self, prompt: Prompt, model: str | None) -> Completion: ...


ClientFactory = Callable[[], Client]


def prompt_text(prompt: Prompt) -> str:
    """The prompt as one text: message contents one per line."""
    if isinstance(prompt, str):
        return prompt
    return "\n".join(part["content"] or "" for part in prompt)


class EchoClient:
    """Deterministic stand-in that repeats the first 50 characters of its prompt."""

    def complete(self, prompt: Prompt, model: str | None) -> Completion:
        return Completion(f"Mock response to: {prompt_text(prompt)[:50]}", 10, 10)


class DigestClient:
    """Stand-in that answers with the length and MD5 of the whole prompt."""

    def complete(self, prompt: Prompt, model: str | None) -> Completion:
        text = prompt_text(prompt)
        return Completion(f"{len(text)}:{hashlib.md5(text.encode()).hexdigest()}", 10, 10)


class AsyncDigestClient:
    """The digest client as a coroutine."""

    async def acomplete(self, prompt: Prompt, model: str | None) -> Completion:
        return DigestClient().complete(prompt, model)


class AsyncEchoClient:
    """The echo client as a coroutine."""

    async def acomplete(self, prompt: Prompt, model: str | None) -> Completion:
        return EchoClient().complete(prompt, model)


class FailingClient:
    """Raises on prompts holding ``marker`` and leaves others to another client, an echo by default."""

    def __init__(self, marker: str, other: Client | None = None):
        self.marker, self.other = marker, other or EchoClient()

    def complete(self, prompt: Prompt, model: str | None) -> Completion:
        if self.marker in prompt_text(prompt):
            raise ValueError("failed")
        return self.other.complete(prompt, model)


class RuleClient:
    """Stand-in whose answer is a function of the prompt."""

    def __init__(self, rule: Callable[[Prompt], str]):
        self.rule = rule

    def complete(self, prompt: Prompt, model: str | None) -> Completion:
        return Completion(self.rule(prompt), 10, 10)
