"""Where speech and language models plug in: callables that run on executors, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import boundary_chunks, clean_markdown, first_title, without_title

#: samples -> (text, confidence, is_partial)
Transcriber = Callable[[list[float]], tuple[str, float, bool]]
#: (system prompt, user prompt) -> text
Generator = Callable[[str, str], str]
#: job (a dict of its columns) -> 'completed', 'chained', 'yielded' or 'failed'
JobProcessor = Callable[[dict], str]
RESULTS = ("completed", "chained", "yielded", "failed")


def process_jobs(jobs: DataFrame, make: Callable[[], JobProcessor], make_summary: Callable[[], JobProcessor] | None = None) -> DataFrame:
    """(queue, entry, phase, result, problem) of jobs (queue, entry, ...): a queue has one worker, which takes its jobs in the order of entry.

    A chained job goes on with the summary processor in its slot, before later jobs; without one it is completed.
    What a processor raises makes its job failed, with the message as the problem; the queue goes on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phases = [("transcribing", make()), *([("summarising", make_summary())] if make_summary else [])]
        for batch in batches:
            out = []
            for job in batch.to_dict("records"):
                for n, (phase, process) in enumerate(phases):
                    try:
                        result, problem = process(job), None
                        if result not in RESULTS:
                            raise ValueError(f"no such result: {result}")
                    except Exception as e:  # one job may fail; the row says so
                        result, problem = "failed", str(e)[:1000]
                    goes_on = result == "chained" and n + 1 < len(phases)
                    out.append((job["queue"], job["entry"], phase, "completed" if result == "chained" and not goes_on else result, problem))
                    if not goes_on:
                        break
            yield pd.DataFrame(out, columns=["queue", "entry", "phase", "result", "problem"])

    ordered = jobs.repartition("queue").sortWithinPartitions("queue", "entry")
    return ordered.mapInPandas(run, "queue long, entry long, phase string, result string, problem string")


def transcribe(segments: DataFrame, make: Callable[[], Transcriber], samples: str = "samples") -> DataFrame:
    """`segments` with text, confidence and is_partial; `make` loads the model once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            got = [model(list(x)) for x in batch[samples]]
            yield batch.drop(columns=[samples]).assign(text=[g[0] for g in got], confidence=[float(g[1]) for g in got], is_partial=[bool(g[2]) for g in got])

    rest = segments.drop(samples).schema.add("text", "string").add("confidence", "double").add("is_partial", "boolean")
    return segments.mapInPandas(run, rest)


def generate(prompts: DataFrame, make: Callable[[], Generator], out: str) -> DataFrame:
    """`prompts` (..., system, prompt) with the generated text; a failure leaves null and its message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            texts, errors = [], []
            for system, prompt in zip(batch["system"], batch["prompt"]):
                try:
                    texts.append(model(system, prompt))
                    errors.append(None)
                except Exception as e:  # a model may fail on one prompt; the row says so
                    texts.append(None)
                    errors.append(str(e)[:1000])
            yield batch.drop(columns=["system", "prompt"]).assign(**{out: texts, "error": errors})

    schema = prompts.drop("system", "prompt").schema.add(out, "string").add("error", "string")
    return prompts.mapInPandas(run, schema)


def summarize(transcripts: DataFrame, make: Callable[[], Generator], size: int = 3700, overlap: int = 100) -> DataFrame:
    """Map-reduce summaries: chunks are summarised, joined in order and summarised again; (meeting_id, title, markdown)."""
    chunks = transcripts.select("meeting_id", F.posexplode(boundary_chunks("text", size, overlap)).alias("no", "prompt")).withColumn("system", F.lit("Summarise this part of a meeting."))
    parts = generate(chunks, make, "part").where("part IS NOT NULL")
    joined = parts.groupBy("meeting_id").agg(F.sort_array(F.collect_list(F.struct("no", "part"))).alias("p"))
    final = joined.select("meeting_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n---\n").alias("prompt"), F.lit("Write the report.").alias("system"))
    done = generate(final, make, "report").withColumn("report", clean_markdown("report"))
    return done.select("meeting_id", first_title("report").alias("title"), without_title("report").alias("markdown"))
