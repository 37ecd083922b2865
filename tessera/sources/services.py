"""Embedding services over HTTP: batches, retries, and smaller batches where one is refused."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

Post = Callable[[str, dict, dict], dict]


def post_json(url: str, body: dict, headers: dict, timeout: float = 60.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.loads(r.read())


# name: (request of a model and texts, vectors in a reply)
PROVIDERS: dict[str, tuple[Callable[[str, list[str]], dict], Callable[[dict], list]]] = {
    "local": (lambda model, texts: {"model": model, "input": texts}, lambda r: r["embeddings"]),
    "hosted": (lambda model, texts: {"model": model, "input": texts}, lambda r: [x["embedding"] for x in sorted(r["data"], key=lambda x: x["index"])]),
    "vertex": (lambda model, texts: {"instances": [{"content": t} for t in texts]}, lambda r: [x["embeddings"]["values"] for x in r["predictions"]]),
}


def embedder(
    provider: str, url: str, model: str, headers: dict | None = None, batch: int = 50, tries: int = 3, wait: float = 0.5, post: Post = post_json, sleep: Callable[[float], None] = time.sleep
) -> Callable[[list[str]], list]:
    """Texts to vectors by a service, for ``embed_symbols`` (which calls it on the executors, batch by batch).

    A request is tried ``tries`` times, each after twice the wait. A batch that
    still fails, or comes back with another number of vectors, is halved; a
    single text that fails has no vector (None).
    """
    request, vectors = PROVIDERS[provider]

    def once(texts: list[str]) -> list:
        for n in range(tries):
            try:
                got = vectors(post(url, request(model, texts), headers or {}))
                if len(got) == len(texts):
                    return got
                break
            except (OSError, ValueError, KeyError, TypeError):
                if n + 1 < tries:
                    sleep(wait * 2**n)
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return once(texts[:half]) + once(texts[half:])

    return lambda texts: [v for lo in range(0, len(texts), batch) for v in once(texts[lo : lo + batch])]
