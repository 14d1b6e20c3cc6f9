"""Requests to answers: classification, validation, dispatch to the pipelines, and the fallback answers.

A request that fails, fails alone: decoding and analysis carry an error for each request, and one with an error gets the
stub's answer and a trace that says why, whatever becomes of the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from ..sources import images as image_source
from . import align, change, components, fusion, stencil

#: Names of tasks and of the models that a stub stands for, answers, and the lines of a trace.
TASKS = {"vqa": "Single-Image VQA", "grounding": "Region Grounding", "change": "Bi-Temporal Change Analysis", "fusion": "Optical + SAR Fusion", "captioning": "Scene Captioning"}
MODELS = {"grounding": "Region Grounding Model", "change": "Change Understanding Model", "fusion": "Optical + SAR Fusion Model", "captioning": "RS Captioning Model"}
IDENTIFIED = {"vqa": "Single-Image Visual Question Answering", "change": "Bi-Temporal Change Analysis", "fusion": "Optical + SAR Multimodal Fusion"}
PIPELINES = {"change": "Change Detection Pipeline", "fusion": "Multimodal Fusion Pipeline"}
NO_IMAGE = "At least one image is required."
NO_MODEL = "Model loading disabled"
VQA_ANSWER = "Several agricultural fields, roads, built-up structures and a water body are visible in this scene. (SIMULATED -- connect a loaded VQA model for a real answer.)"
ROUTING = {"change": ("Routing to change analysis pipeline", "Change analysis pipeline complete", "Change"), "fusion": ("Routing to Optical + SAR fusion pipeline", "Fusion pipeline complete", "Fusion")}

C = F.col


def classified(requests: DataFrame) -> DataFrame:
    """Adds task and error (null if valid). ``requests``: request_id, query, n_images, content_types array, perhaps filenames array."""
    task = text.intent(C("query"))
    names = C("filenames") if "filenames" in requests.columns else F.array().cast("array<string>")
    bad = F.filter(F.transform("content_types", lambda c, i: F.struct(c.alias("kind"), F.coalesce(F.get(names, i), F.lit("image")).alias("name"))), lambda f: ~f["kind"].isin(*text.SERVER_UPLOADS))
    first = F.get(bad, F.lit(0))
    error = (
        F.when(C("n_images") < 1, NO_IMAGE)
        .when(F.size(bad) > 0, F.concat(F.lit("Unsupported format '"), first["kind"], F.lit("' for "), first["name"], F.lit(".")))
        .when(C("task").isin("change", "fusion") & (C("n_images") < 2), F.concat(F.lit("Task '"), C("task"), F.lit("' requires two co-registered images (received "), C("n_images").cast("string"), F.lit(").")))
    )
    return requests.withColumn("task", task).withColumn("error", error)


def answered(requests: DataFrame, results: dict[str, DataFrame] | None = None, no_model: str = NO_MODEL) -> DataFrame:
    """One row per request: task, model, answer, confidence, trace, picture, simulated.

    ``results`` maps a task to (request_id, answer, confidence 0-100, trace) of its pipeline, perhaps with picture, simulated,
    and error. A request with an error, or that the pipeline gave nothing for, gets the stub's answer; an error is in its trace.
    """
    r = classified(requests)
    name, model = text.by_name(C("task"), TASKS), text.by_name(C("task"), MODELS)
    start = F.array(F.lit("Query received"), F.lit("Query classified"))
    ok = F.concat(F.lit("Input validated: "), C("n_images").cast("string"), F.lit(" image(s)"))
    kinds = {"answer": "string", "confidence": "int", "steps": "array<string>", "picture": "string", "real": "boolean", "fault": "string"}
    r = r.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    for task, found in (results or {}).items():
        extra = lambda c, k: C(c).cast(k) if c in found.columns else F.lit(None).cast(k)  # noqa: E731, B023 - used at once
        given = {"answer": C("answer"), "confidence": C("confidence").cast("int"), "steps": C("trace"), "picture": extra("picture", "string"), "real": ~extra("simulated", "boolean"), "fault": extra("error", "string")}
        f = found.select("request_id", *[v.alias("_" + c) for c, v in given.items()])
        own = (C("task") == task) & C("error").isNull()
        r = r.join(f, "request_id", "left").withColumns({c: F.when(own, C("_" + c)).otherwise(C(c)) for c in kinds}).drop(*["_" + c for c in kinds])
    bad, vqa = C("error").isNotNull(), C("task") == "vqa"
    done = C("answer").isNotNull() & C("fault").isNull()
    stub = F.concat(F.lit("This is a placeholder response for '"), name, F.lit("'. Train and wire in the "), model, F.lit("."))
    identified = F.concat(F.lit("Task identified: "), F.coalesce(text.by_name(C("task"), IDENTIFIED), name))
    plain = F.concat(F.lit("Task identified: "), name)
    waiting = F.concat(F.lit("Specialist model '"), model, F.lit("' not yet integrated -- returning simulated output"))
    lines = (
        F.when(bad, F.array(F.concat(F.lit("Input validation FAILED: "), C("error"))))
        .when(done, F.concat(F.array(ok, identified), F.coalesce("steps", F.array().cast("array<string>"))))
        .when(vqa, F.array(ok, identified, F.lit(f"Real VQA model unavailable ({no_model}) -- using simulated fallback")))
        .when(C("fault").isNotNull(), F.concat(F.array(ok, identified), F.coalesce("steps", F.array().cast("array<string>")), F.array(F.concat(initial(C("task")), F.lit(" pipeline error: "), C("fault"), F.lit(" — falling back to stub")), plain, waiting)))
        .otherwise(F.array(ok, plain, waiting))
    )
    by = F.concat(text.by_name(C("task"), PIPELINES), F.when(C("real"), " + LLaVA").otherwise(" (rule-based)"))
    return r.select(
        "request_id", "query", F.when(bad, "Validation Error").otherwise(name).alias("task"),
        F.when(bad, "-").when(done, F.coalesce(by, F.lit("Specialist model"))).when(vqa, "Simulated (no model loaded)").otherwise(F.concat(F.lit("Simulated ("), model, F.lit(" not yet trained/integrated)"))).alias("model"),
        F.when(bad, C("error")).when(done, C("answer")).when(vqa, VQA_ANSWER).otherwise(stub).alias("answer"),
        F.when(bad, 0).when(done, C("confidence")).when(vqa, 60).otherwise(50).alias("confidence"), F.concat(start, lines).alias("trace"),
        F.when(done, C("picture")).alias("picture"), F.when(done, ~F.coalesce("real", F.lit(False))).otherwise(True).alias("simulated"),
    )


def initial(task: Column) -> Column:
    return text.by_name(task, {k: v[2] for k, v in ROUTING.items()})


def pair_sizes(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes for ``stencil.resize_scenes`` of both rasters of every scene: the smaller height and width of the two."""
    size = lambda d: d.groupBy("scene_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    a, b = size(one), size(two)
    both = align.matched(a, b)
    return a.join(both, "scene_id"), b.join(both, "scene_id")


def run(requests: DataFrame, images: DataFrame, no_model: str = NO_MODEL) -> DataFrame:
    """Answers of all requests, with the pipelines of change and fusion run on their images.

    ``requests``: request_id, query; ``images``: request_id, position from 0, filename, content_type, content. Images beyond the
    second of a pair are not read. An image that can't be decoded is its request's error; the others go on.
    """
    listed = images.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("position", "content_type", "filename"))).alias("i"))
    whole = requests.join(listed, "request_id", "left").select("request_id", "query", F.coalesce(F.size("i"), F.lit(0)).alias("n"), F.coalesce(C("i.content_type"), F.array().cast("array<string>")).alias("content_types"), F.coalesce(C("i.filename"), F.array().cast("array<string>")).alias("filenames"))
    whole = whole.select("request_id", "query", F.greatest("n", F.lit(0)).alias("n_images"), "content_types", "filenames")
    valid = classified(whole).where("error IS NULL AND task IN ('change', 'fusion')").select("request_id", "query", "task")
    files = images.where("position < 2").join(valid, "request_id").select("request_id", "task", "position", "content")
    pixels = components.settled(image_source.decoded(files, ["request_id", "task", "position"]))
    broken = pixels.where("error IS NOT NULL").groupBy("request_id").agg(F.min_by("error", "position").alias("error"))
    good = pixels.where("error IS NULL").join(broken.select("request_id"), "request_id", "left_anti").withColumnRenamed("request_id", "scene_id")
    half = lambda task, k: good.where((C("task") == task) & (C("position") == k))
    questions = lambda task: valid.where(C("task") == task).select(C("request_id").alias("scene_id"), "query")

    def resized(one: DataFrame, two: DataFrame, bands: list[str], others: list[str], ranged: bool) -> tuple[DataFrame, DataFrame]:
        sizes = pair_sizes(one, two)
        return stencil.resize_scenes(one, bands, sizes[0], ranged), stencil.resize_scenes(two, others, sizes[1], ranged)

    rgb = lambda d: d.select("scene_id", "y", "x", *[c.alias(n) for n, c in zip("rgb", image_source.colours(C("n_bands"), C("v1"), C("v2"), C("v3")))])
    pairs = change.joined(*resized(rgb(half("change", 0)), rgb(half("change", 1)), ["r", "g", "b"], ["r", "g", "b"], False))
    changed = change.analyse(pairs, questions("change"))
    changed = changed.select(C("scene_id").alias("request_id"), C("summary").alias("answer"), scores.to_percent(F.lit("change"), C("overall_confidence")).alias("confidence"), "trace", "simulated")

    optical, radar = half("fusion", 0), half("fusion", 1)
    # files of three bands are red, green, blue, as pictures are
    b02, b03, b04, b08 = image_source.mapped_bands(C("n_bands"), C("v1"), C("v2"), C("v3"), C("v4"))
    optical = optical.select("scene_id", "y", "x", b02.alias("b02"), b03.alias("b03"), b04.alias("b04"), b08.alias("b08"))
    vv, vh = image_source.radar_bands(F.when(C("picture"), 1).otherwise(C("n_bands")), C("v1"), C("v2"))
    radar = radar.select("scene_id", "y", "x", vv.alias("vv_raw"), vh.alias("vh_raw"))
    optical, radar = resized(optical, radar, ["b02", "b03", "b04", "b08"], ["vv_raw", "vh_raw"], True)
    fused = fusion.analyse(optical.join(radar, ["scene_id", "y", "x"]), questions("fusion"))
    fused = fused.select(C("scene_id").alias("request_id"), C("summary").alias("answer"), scores.to_percent(F.lit("fusion"), C("confidence")).alias("confidence"), "trace", "simulated")
    results = {}
    for task, found in (("change", changed), ("fusion", fused)):
        own = valid.where(C("task") == task).select("request_id").join(found, "request_id", "left").join(broken, "request_id", "left")
        begin, end, _ = ROUTING[task]
        failed = F.coalesce("error", F.when(C("answer").isNull(), "no pixels in common"))
        steps = F.when(failed.isNull(), F.concat(F.array(F.lit(begin)), C("trace"), F.array(F.lit(end)))).otherwise(F.array(F.lit(begin)))
        results[task] = own.select("request_id", "answer", "confidence", steps.alias("trace"), "simulated", failed.alias("error"))
    return answered(whole, results, no_model)


def with_model(requests: DataFrame, answer: Callable[[bytes, str], tuple[str, float]], image: str = "content", query: str = "query") -> DataFrame:
    """Hook for a vision-language model: ``answer(image, question)`` gives text and confidence. Loaded once per worker by
    whoever supplies it; failures give nulls, which ``answered`` turns into the fallback."""
    import pandas as pd

    @F.pandas_udf("answer string, confidence double")
    def ask(images: pd.Series, questions: pd.Series) -> pd.DataFrame:
        out = []
        for i, q in zip(images, questions):
            try:
                out.append(answer(i, q))
            except Exception:  # noqa: BLE001 - a model's failure is an expected outcome here
                out.append((None, None))
        return pd.DataFrame(out, columns=["answer", "confidence"])

    return requests.withColumn("model_answer", ask(F.col(image), F.col(query)))
