"""Parameters of the catalogue's queries."""

from __future__ import annotations

#: The prompt of the recall queries, tokenized; the last term repeats, as appended context may.
PROMPT = "How do thtion and ering relate to thea, der keit, src3/en or erly? thtion ontion"
TOKENS = ["thtion", "ering", "thea", "der", "keit", "src3/en", "src3", "en", "erly", "ontion", "ering"]
PROJECT, ENTITY, MIN_MATCH = "src3", "src3/en", 2.0
#: Prompts of the evaluation cases.
CASES = [["thtion", "ering", "erly"], ["keit", "src5", "der"], ["thea", "ontion"]]
#: Every BATCH-th memory is new in the write queries.
BATCH = 10
#: Microseconds after which a save is no longer reported, in the stream over events.
SAVES_TTL = 24 * 3600 * 1_000_000
