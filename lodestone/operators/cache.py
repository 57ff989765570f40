"""Caches of answers: exact keys, keys matched by meaning, and model answers fenced by data versions."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import FRESH_WORDS, slot_consistent
from lodestone.functions.vectors import cosine
from lodestone.operators import topk
from lodestone.plans.errors import invalid
from lodestone.plans.requests import QueryRequest, canonical
from lodestone.plans.schema import EntitySchema

TTL, LLM_TTL, CAPACITY, SEMANTIC_COSINE, RECALL_COSINE, RERANK = 60.0, 3600.0, 1000, 0.88, 0.80, 0.90
MOST_CHARS, DENSE, LEXICAL = 100_000, 5, 12


def key_of(request: QueryRequest) -> str:
    return f"{request.entity}:{hashlib.sha256(canonical(request).encode()).hexdigest()[:16]}"


def fresh_wanted(text: str | None, words: tuple[str, ...] = FRESH_WORDS) -> bool:
    return any(w in (text or "") for w in words)


@dataclass
class ExactCache:
    """Answers by key with a time to live; an entity's answers can be dropped together without a scan."""

    clock: Callable[[], float] = time.monotonic
    capacity: int = CAPACITY
    fresh_words: tuple[str, ...] = FRESH_WORDS
    entries: dict[str, tuple[float, object]] = field(default_factory=dict)
    members: dict[str, set[str]] = field(default_factory=dict)

    def get(self, key: str):
        until, value = self.entries.get(key, (0.0, None))
        return value if until > self.clock() else None

    def put(self, key: str, value, ttl: float = TTL) -> None:
        if value is None:
            raise invalid("a value is required")
        self.entries[key] = (self.clock() + (ttl if ttl > 0 else TTL), value)
        self.members.setdefault(key.split(":")[0], set()).add(key)
        if len(self.entries) > self.capacity:
            for old in sorted(self.entries, key=lambda k: self.entries[k][0])[: len(self.entries) - self.capacity]:
                self.delete(old)

    def delete(self, key: str) -> bool:
        self.members.get(key.split(":")[0], set()).discard(key)
        return self.entries.pop(key, None) is not None

    def invalidate(self, entity: str) -> int:
        keys = self.members.pop(entity, set())
        return sum(self.entries.pop(k, None) is not None for k in keys)

    def keys(self, prefix: str = "") -> list[str]:
        return sorted(k for k, (until, _) in self.entries.items() if k.startswith(prefix) and until > self.clock())

    def through(self, request: QueryRequest, run: Callable[[QueryRequest], object]):
        """Reads unless fresh data is asked for, by the request or by a word of its filters; always stores."""
        key = key_of(request)
        asked = [*request.filters.values(), *request.text.values()]
        fresh = request.fresh or any(fresh_wanted(v, self.fresh_words) for v in asked if isinstance(v, str))
        if not fresh and (hit := self.get(key)) is not None:
            return hit
        value = run(request)
        self.put(key, value)
        return value


@dataclass
class SemanticCache:
    """Answers to requests whose hard parts are equal and whose string filters mean the same."""

    embed: Callable[[str], list[float]]
    threshold: float = SEMANTIC_COSINE
    fingerprint: str = "default"
    clock: Callable[[], float] = time.monotonic
    entries: list[dict] = field(default_factory=list)

    @staticmethod
    def split(request: QueryRequest, schema: EntitySchema) -> tuple[str, str]:
        soft = [str(v) for k, v in sorted(request.filters.items()) if isinstance(v, str) and (f := schema.find(k)) is not None and f.type == "STRING"]
        return canonical(request, schema, semantic=True), ";".join(soft)

    def get(self, request: QueryRequest, schema: EntitySchema):
        hard, soft = self.split(request, schema)
        if not soft or request.fresh or fresh_wanted(soft):
            return None
        v = self.embed(soft)
        best = max(((_cosine(v, e["vector"]), -i) for i, e in enumerate(self.entries) if e["hard"] == hard and e["fingerprint"] == self.fingerprint and e["until"] > self.clock()), default=(0.0, 0))
        return self.entries[-best[1]]["value"] if best[0] >= self.threshold else None

    def put(self, request: QueryRequest, schema: EntitySchema, value: list, ttl: float = TTL) -> bool:
        hard, soft = self.split(request, schema)
        if not soft or not value:
            return False
        self.entries.append({"hard": hard, "soft": soft, "vector": self.embed(soft), "value": value, "fingerprint": self.fingerprint, "until": self.clock() + ttl, "entity": request.entity})
        mine = [e for e in self.entries if e["entity"] == request.entity]
        for old in sorted(mine, key=lambda e: e["until"])[: max(0, len(mine) - CAPACITY)]:
            self.entries.remove(old)
        return True

    def invalidate(self, entity: str) -> int:
        """Drops the answers of an entity, as its exact ones are."""
        before = len(self.entries)
        self.entries = [e for e in self.entries if e["entity"] != entity]
        return before - len(self.entries)

    def reindex(self) -> dict:
        """Entries of another embedder get new vectors."""
        report = {"scanned": len(self.entries), "skipped": 0, "migrated": 0, "failed": 0}
        for e in self.entries:
            if e["fingerprint"] == self.fingerprint:
                report["skipped"] += 1
                continue
            try:
                e["vector"], e["fingerprint"] = self.embed(e["soft"]), self.fingerprint
                report["migrated"] += 1
            except Exception:  # an entry that can't be embedded stays as it is
                report["failed"] += 1
        return report


def _cosine(a: list[float], b: list[float]) -> float:
    na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if len(a) == len(b) and na and nb else 0.0


def fenced(entries: DataFrame, versions: DataFrame, id_col: str = "entry_id", deps: str = "dependencies") -> DataFrame:
    """Adds current: are all versions that an entry was made from still those of today? No dependencies: yes."""
    each = entries.select(F.col(id_col), F.explode(deps).alias("entity", "then"))
    ok = each.join(versions, "entity", "left").groupBy(id_col).agg(F.bool_and(F.coalesce(F.col("then") == F.col("version"), F.lit(False))).alias("__ok"))
    return entries.join(ok, id_col, "left").withColumn("current", F.coalesce("__ok", F.lit(True))).drop("__ok")


def evict(entries: DataFrame, expires: str, keep: int, id_col: str) -> DataFrame:
    """The entries that live longest, at most ``keep``."""
    return entries.orderBy(F.desc(expires), F.desc(id_col)).limit(keep)


def alive(entries: DataFrame, expires: str, now: Column) -> DataFrame:
    return entries.where(F.col(expires) > now)


def candidates(entries: DataFrame, prompt: str, vector: list[float], recall: float = RECALL_COSINE) -> DataFrame:
    """Entries that may answer: fused from vectors and words as independent channels, then by cosine and by equal digits.
    ``entries``: entry_id, prompt, vector and whatever else."""
    fused = topk.rrf([topk.knn(entries, "entry_id", "vector", vector, DENSE), topk.bm25(entries, "entry_id", "prompt", prompt, LEXICAL)])
    q = F.array(*(F.lit(float(x)) for x in vector))
    met = entries.join(F.broadcast(fused.withColumnRenamed("id", "entry_id")), "entry_id")
    met = met.withColumn("cosine", cosine(F.col("vector"), q))
    return met.where((F.col("cosine") >= recall) & slot_consistent(F.col("prompt"), F.lit(prompt)))


def lookup(entries: DataFrame, versions: DataFrame, prompt: str, vector: list[float] | None, reranker: Callable[[str, str], float] | None = None, bypass: bool = False, enabled: bool = True, recall: float = RECALL_COSINE, rerank: float = RERANK) -> tuple[str, dict | None]:
    """(reason, entry): hit, or why not: bypass, disabled, fresh-keyword, no-embedder, empty-vector, stale, no-match,
    rerank-error. A reranker is asked both ways round, and the lower score counts."""
    if bypass:
        return "bypass", None
    if not enabled:
        return "disabled", None
    if fresh_wanted(prompt):
        return "fresh-keyword", None
    exact = fenced(entries.where(F.sha2("prompt", 256) == hashlib.sha256(prompt.encode()).hexdigest()), versions).orderBy(F.desc("current"), "entry_id").limit(1).collect()
    if exact:
        return ("hit", exact[0].asDict()) if exact[0]["current"] else ("stale", None)
    if vector is None:
        return "no-embedder", None
    if not any(vector):
        return "empty-vector", None
    found = fenced(candidates(entries, prompt, vector, recall), versions).orderBy(F.desc("score"), "entry_id").collect()
    if not found:
        return "no-match", None
    usable = [r.asDict() for r in found if r["current"]]
    if not usable:
        return "stale", None
    if reranker is None:
        return "hit", usable[0]
    try:
        scores = [min(reranker(prompt, r["prompt"]), reranker(r["prompt"], prompt)) for r in usable]
    except Exception:  # a model elsewhere may fail in any way
        return "rerank-error", None
    best = max(range(len(usable)), key=lambda i: scores[i])
    return ("hit", usable[best]) if scores[best] >= rerank else ("no-match", None)


def storable(prompt: str, response: str) -> bool:
    return bool(prompt and response) and len(prompt) + len(response) <= MOST_CHARS


def stored(entries: DataFrame, new: DataFrame, now: Column, keep: int = CAPACITY) -> DataFrame:
    """The cache of model answers after a write: (entry_id, prompt, response, expires, ..). New entries replace those of
    their prompt, unless they are too long or empty; the expired go, and of more than ``keep`` those that expire first."""
    fits = new.where((F.char_length(F.coalesce("prompt", F.lit(""))) > 0) & (F.char_length(F.coalesce("response", F.lit(""))) > 0) & (F.char_length("prompt") + F.char_length("response") <= MOST_CHARS))
    kept = entries.join(fits.select("prompt"), "prompt", "left_anti").unionByName(fits)
    return evict(alive(kept, "expires", now), "expires", keep, "entry_id")


def cleared(entries: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """The cache without the prompts named; without any, nothing of it."""
    return entries.limit(0) if prompts is None else entries.join(prompts.select(F.col(prompts.columns[0]).alias("prompt")), "prompt", "left_anti")


def expanded(prompt: str, ask: Callable[[str], list], paraphrase: Callable[[str], list[str]] | None = None, mode: str = "off", most: int = 3) -> list:
    """Answers to a prompt, and, with ``always`` or where there are none with ``on-miss``, to paraphrases of it, each
    once, in the order found. A paraphraser that fails adds nothing."""
    if mode not in ("off", "on-miss", "always"):
        raise invalid(f"unknown mode {mode}")
    found = list(ask(prompt))
    if paraphrase is None or mode == "off" or (mode == "on-miss" and found):
        return found
    try:
        others = [p for p in dict.fromkeys(paraphrase(prompt)) if p and p != prompt][:most]
    except Exception:  # a model elsewhere may fail in any way
        return found
    for p in others:
        found += [a for a in ask(p) if a not in found]
    return found


def stats(hits: int, misses: int) -> dict:
    return {"hits": hits, "misses": misses, "hitRate": hits / (hits + misses) if hits + misses else 0.0}
