"""The hash sampler is a stateless row predicate, so it applies unchanged to
a streaming DataFrame and selects exactly the batch sample's rows."""

import uuid

from roughcut.operators import sampling
from roughcut.session import shared_dir
from tests.conftest import SF01


def test_hash_sample_on_a_stream(spark):
    batch = spark.read.parquet(f"{SF01}/events.parquet")
    stream = (spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet")
              .parquet(SF01))
    sampled = sampling.uniform_sample(stream, 0.1, key="event_id").select("event_id")
    name = f"sample_{uuid.uuid4().hex[:8]}"
    q = (sampled.writeStream.format("memory").queryName(name)
         .option("checkpointLocation", shared_dir(spark, "test", "stream", name))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r[0] for r in spark.table(name).collect()}
    want = {r[0] for r in sampling.uniform_sample(batch, 0.1, key="event_id").select("event_id").collect()}
    assert got == want and len(want) == 1046
