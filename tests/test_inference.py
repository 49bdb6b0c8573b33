import json
import random

import pytest

from vellumine.plans import config as cfg
from vellumine.plans import jsonschema
from vellumine.plans.inference import categories, infer, inferred_globs, preprocess_for, value_ranges
from vellumine.plans.paths import directory_counts, field_globs
from vellumine.sources.frontmatter import documents, leaves


def vault(spark, files):
    return documents(spark.createDataFrame([(p, x if isinstance(x, str) else json.dumps(x) + "\nbody") for p, x in files.items()], "path string, raw string"))


def globs(spark, files):
    rows = [(p, [(x, "String", True) for x in names]) for p, names in files.items()]
    counts = directory_counts(spark.createDataFrame(rows, "path string, leaves array<struct<field: string, type: string, first: boolean>>"))
    return {r.field: (r.allowed, r.required) for r in field_globs(counts).collect()}


def walked(files):
    """The same by the definition: sets of a directory are what all of its parts share."""
    groups, nodes = {}, {""}
    for path, names in files.items():
        groups.setdefault(path.rpartition("/")[0], []).append(set(names))
    for at in groups:
        parts = at.split("/") if at else []
        nodes |= {"/".join(parts[:i]) for i in range(len(parts) + 1)}
    below = {n: [g for g in groups if n in ("", g) or g.startswith(f"{n}/")] for n in nodes}
    sets = {"ever": {g: set.union(*x) for g, x in groups.items()}, "always": {g: set.intersection(*x) for g, x in groups.items()}}
    out = {}
    for name in set.union(*sets["ever"].values()):
        found = []
        for kind in ("ever", "always"):
            full = {n for n in nodes if all(name in sets[kind][g] for g in below[n])}
            top = {n for n in full if n == "" or n.rpartition("/")[0] not in full}
            deep = {f"{n}/**".lstrip("/") for n in top}
            found.append(sorted(deep | ({f"{g}/*".lstrip("/") for g in groups if name in sets[kind][g] and g not in full} if kind == "ever" else set())))
        out[name] = tuple(found)
    return out


@pytest.mark.parametrize(
    ("files", "field", "allowed", "required"),
    [
        ({"blog/a": ["title", "tags"], "blog/b": ["title"], "notes/c": ["title", "tags"], "notes/d": ["title", "tags"]}, "tags", ["**"], ["notes/**"]),
        ({"blog/a": ["title", "tags"], "blog/b": ["title", "tags"], "papers/x": ["title", "doi"], "papers/y": ["title", "doi"]}, "doi", ["papers/**"], ["papers/**"]),
        ({"blog/posts/a": ["tags"], "blog/posts/b": ["tags"], "blog/drafts/c": ["draft"], "papers/x": ["doi"]}, "draft", ["blog/drafts/**"], ["blog/drafts/**"]),
        ({"blog/post1": ["title", "tags"], "blog/post2": ["title"], "blog/drafts/d1": ["title", "tags"], "blog/drafts/d2": ["title", "tags"], "notes/i1": ["title", "tags"], "notes/i2": ["title", "tags"], "papers/p": ["title"]}, "tags", ["blog/**", "notes/**"], ["blog/drafts/**", "notes/**"]),
        ({"readme": ["title", "featured"], "blog/a": ["title"]}, "featured", ["*"], []),
    ],
)
def test_globs(spark, files, field, allowed, required):
    assert globs(spark, files)[field] == walked(files)[field] == (allowed, required)


def test_globs_of_deep_trees(spark):
    rng = random.Random(3)
    for _ in range(3):
        files = {"/".join(rng.choice("abc") for _ in range(rng.randrange(5))) + f"/f{i}": [x for x in "xyz" if rng.random() < 0.8] for i in range(60)}
        files = {p.lstrip("/"): names for p, names in files.items()}
        assert globs(spark, files) == walked(files)


def test_globs_take_little_memory_of_a_task(spark):
    docs = vault(spark, {f"d{i % 7}/e{i % 3}/{i}.md": {"a": 1} | ({"b": 2} if i % 7 else {}) for i in range(60)}).cache()
    docs.count()
    tracker, group = spark.sparkContext.statusTracker(), "globs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = inferred_globs(docs)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        docs.unpersist()
    assert found["a"] == (["**"], ["**"]) and found["b"] == ([f"d{i}/**" for i in range(1, 7)],) * 2
    stages = {k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds}
    context = spark.sparkContext
    listed = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    peaks = [x.peakExecutionMemory() / max(1, x.numCompleteTasks()) for x in (listed.apply(i) for i in range(listed.size())) if x.stageId() in stages]
    assert 0 < max(peaks) < 100_000_000


def test_values_and_types(spark):
    files = {f"a/{i}.md": {"status": s, "items": v, "funding": f, "gone": None, "deep": {"x": i}} for i, (s, v, f) in enumerate([("draft", [1, 2], "internal"), ("draft", [1, 2], ["internal"]), ("done", [4.5], "internal"), ("done", [], ["internal"]), ("done", [1], "internal"), ("done", [1], ["internal"])])}
    files["a/bare.md"] = "no frontmatter"
    docs = vault(spark, files)
    found = {x.name: x for x in infer(docs).fields}
    assert found["items"].type == "Array(String)" and found["items"].preprocess == ["coerce-to-string"]
    assert (found["funding"].type, found["funding"].n_distinct, found["funding"].occurrences) == ("String", 2, 6)
    assert categories(found["funding"]) == ['["internal"]', "internal"]
    assert found["gone"].type == "String" and found["gone"].nullable and found["gone"].n_distinct == 0
    assert found["deep.x"].type == "Integer" and found["status"].required == []
    assert categories(found["status"]) == ["done", "draft"] and categories(found["status"], repetition=4) is None
    # distinct arrays only are counted
    assert found["items"].occurrences == 4
    bounds = {r.field: (r.min, r.max) for r in value_ranges(leaves(docs)).collect()}
    assert bounds["items"] == (1.0, 4.5) and bounds["deep.x"] == (0.0, 5.0)
    again = {x.name: x for x in infer(docs.repartition(7)).fields}
    assert again == found


def test_objects_in_arrays_are_dropped(spark):
    found = infer(vault(spark, {"a.md": {"x": [{"y": 1}], "z": 1}}))
    assert found.dropped == ["x"] and [x.name for x in found.fields] == ["z"]
    assert infer(vault(spark, {"b.md": "bare"})).fields == []


def test_preprocess():
    assert preprocess_for(["Float", "Integer"], "Float") == ["widen-int-to-float"]
    assert preprocess_for(["Array(Integer)", "Array(Float)"], "Array(Float)") == ["widen-int-to-float"]
    assert preprocess_for(["Date", "String"], "String") == ["coerce-to-string"]


CONFIG = """
[scan]
glob = "**"
[search]
default_limit = 5
[fields]
ignore = ["odd"]
[[fields.field]]
name = "b.c"
type = "Array(Integer)"
nullable = false
[[fields.field]]
name = "a"
type = "String"
allowed = ["x/**"]
required = ["x/y/**"]
[fields.field.constraints]
min_length = 1
pattern = "^a"
"""


def test_config_round_trip():
    config = cfg.parse_config(CONFIG)
    cfg.check_config(config)
    assert cfg.parse_config(cfg.config_text(config)).fields == sorted(config.fields, key=lambda x: x.name)


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (("ignore = [\"odd\"]", "ignore = [\"a\"]"), "at once"),
        (('name = "a"', 'name = ".a"'), "dotted name"),
        (('name = "a"', 'name = "b"'), "values of its own"),
        (('"x/**"', '"x/y"'), "directory"),
        (('"x/y/**"', '"z/**"'), "allowed"),
        (("min_length = 1", "min = 1"), "can't limit"),
        (("min_length = 1", 'categories = ["a"]'), "nothing for other"),
        (('"^a"', '"(a"'), "compile"),
        (('"^a"', '"(?=a)"'), "look neither"),
        (('type = "String"', 'type = "Object"'), "type can't be read"),
        (("default_limit", "default_limits"), "no setting"),
        (('allowed = ["x/**"]', 'preprocess = ["widen-int-to-float"]\nallowed = ["x/**"]'), "doesn't hold"),
    ],
)
def test_config_rules(change, said):
    with pytest.raises(cfg.ConfigError, match=said):
        cfg.check_config(cfg.parse_config(CONFIG.replace(*change)))


def test_json_schema_round_trip(tmp_path):
    config = cfg.parse_config(CONFIG)
    config.fields.append(cfg.Field("day", "Date", constraints=cfg.Constraints(categories=["2024-01-15"])))
    back, warnings = jsonschema.from_json_schema(json.loads(jsonschema.export_schema(config)))
    assert back.fields == sorted(config.fields, key=lambda x: x.name) and back.ignore == ["odd"] and not warnings
    (tmp_path / "s.toml").write_text(jsonschema.export_schema(config, "toml"))
    assert jsonschema.from_json_schema(jsonschema.load_schema(tmp_path / "s.toml"))[0].fields == back.fields
    for wrong in ({"oneOf": []}, {"foo": 1}, {"properties": {"a": {"type": "string", "format": "email"}}}, {"properties": {"a": {"type": "array"}}}, {}):
        with pytest.raises(cfg.ConfigError):
            jsonschema.from_json_schema(wrong)
    assert jsonschema.from_json_schema({"properties": {"a": {"type": "integer", "multipleOf": 2}}})[1]


def test_update(spark):
    docs = vault(spark, {"x/a.md": {"a": "s", "new": 1}})
    config = cfg.parse_config(CONFIG)
    found = infer(docs)
    assert cfg.schema_diff(config, found)["added"] == ["new"] and cfg.schema_diff(config, found)["removed"] == ["b.c"]
    assert cfg.add_new_fields(config, found) == ["new"]
    assert {x.name for x in cfg.reinfer(config, found, ["a"]).fields} == {"a", "b.c", "new"}
    assert [x.name for x in cfg.reinfer(config, found).fields] == ["a", "new"]
    with pytest.raises(cfg.ConfigError):
        cfg.reinfer(config, found, ["nothing"])
    assert len(cfg.name_hints("""it's "a b" """)) == 3
