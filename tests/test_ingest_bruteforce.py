"""Several ingest runs against one-document-at-a-time bookkeeping in plain Python."""

import hashlib
import random
import re
import uuid

import pytest

from askorpus.operators.chunking import recursive_splitter
from askorpus.plans import ingest as ing
from askorpus.providers import HashingEmbedder
from askorpus.sources.store import Store
from test_chunking import restated
from test_functions import quality
from test_ingest import raw


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chunk_key(chunk):
    return sha(re.sub(r"\s+", " ", chunk.strip().lower()))


class Bookkeeping:
    """url -> (document hash, chunks), changed by one document after another."""

    def __init__(self, compat):
        self.compat, self.hashes, self.chunks = compat, {}, {}

    def run(self, docs):
        changed = {u for u, t in docs.items() if self.hashes.get(u) != sha(t)}
        kept = self.chunks if self.compat else {u: c for u, c in self.chunks.items() if u not in changed}
        seen = {chunk_key(c) for chunks in kept.values() for c in chunks}
        out = {}
        for url in sorted(docs, key=lambda u: hashlib.sha1(u.encode()).hexdigest()):
            if url not in changed:
                out[url] = ("unchanged", 0)
                continue
            fresh = []
            for chunk in restated(docs[url], 200, 40):
                if quality(chunk) and chunk_key(chunk) not in seen:
                    seen.add(chunk_key(chunk))
                    fresh.append(chunk)
            known = url in self.hashes
            out[url] = ("empty" if not fresh else "updated" if known else "inserted", len(fresh))
            if fresh or not self.compat:
                self.hashes[url], self.chunks[url] = sha(docs[url]), fresh
        return out

    def rows(self):
        return sorted((str(uuid.uuid5(uuid.NAMESPACE_URL, f"{u}#{i}")), u, i, c, self.hashes[u])
                      for u, chunks in self.chunks.items() for i, c in enumerate(chunks))


def sentences(rng):
    words = ["sol", "mar", "río", "monte", "[enlace](http://x.test/" + "y" * 60 + ")", "nube", "valle"]
    return [" ".join(rng.choices(words, k=rng.randint(3, 30))).capitalize() + rng.choice([". ", "? ", ".\n", "!\n\n"])
            for _ in range(30)]


@pytest.mark.parametrize("compat", [False, True])
def test_runs(spark, tmp_path, compat):
    rng = random.Random(11)
    pool = sentences(rng)
    store = Store(spark, str(tmp_path / "s"), ing.TABLES)
    books = Bookkeeping(compat)

    def write():
        # boilerplate that a third of the documents share
        shared = [pool[0] * 3] if rng.random() < 0.35 else []
        return "".join(shared + rng.choices(pool, k=rng.randint(0, 12)))

    docs = {f"https://d.test/{i}": write() for i in range(60)}
    for step in range(3):
        out = ing.ingest(store, raw(spark, docs), recursive_splitter(200, 40), HashingEmbedder(4), compat=compat)
        assert {r.url: (r.kind, r.n_chunks) for r in out.collect()} == books.run(docs)
        got = store.read("chunks").select("chunk_id", "url", "chunk_index", "content", "content_hash").collect()
        assert sorted(map(tuple, got)) == books.rows()
        for url in rng.sample(sorted(docs), 20):
            docs[url] = docs[url] + rng.choice(pool) if rng.random() < 0.5 else write()
        docs.update({f"https://d.test/new{step}-{i}": write() for i in range(5)})
