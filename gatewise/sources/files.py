"""One way in and out for every kind of file, chosen by its extension."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.populations import Objects, Strategy
from . import container, daf, fcs, gatingml, run
from .parts import place_of


def kind_of(path: str) -> str:
    """fcs, daf, container (rif, cif), template (ast, ist) or gates (xml)."""
    kinds = {"fcs": "fcs", "lmd": "fcs", "daf": "daf", "rif": "container", "cif": "container", "ast": "template", "ist": "template", "xml": "gates"}
    found = kinds.get(path.rsplit(".", 1)[-1].lower())
    if found is None:
        raise ValueError(f"{path!r}: the kind of file isn't known; known: {', '.join(kinds)}")
    return found


def read(spark: SparkSession, path: str, **options) -> Objects | Strategy | DataFrame:
    """Objects of FCS and analysis files and of containers (with where their images
    are), gates of templates and XML; ``path`` may be a pattern of files of one kind."""
    kind = kind_of(path)
    if kind == "fcs":
        df = fcs.read_fcs(spark, path, **options)
        own = [c for c in df.columns if c not in ("import_file", "import_subfile", "object_number")]
        return Objects.of(df, file_col="import_file", features=own)
    if kind == "daf":
        return daf.read_daf(spark, path, **options)
    if kind == "container":
        return read_container(spark, path, **options)
    if kind == "template":
        return Strategy(daf.definitions(ET.fromstring(daf.read_heads(spark, path).first()["head"])))
    text = spark.read.option("wholetext", True).text(path).first()[0]  # definitions, no objects
    return gatingml.parse(text)


def read_container(spark: SparkSession, paths: str | list[str]) -> Objects:
    """The objects of containers: import_file, object_number, the features that the files
    store and the columns of ``container.image_rows``, with the definitions that the
    first file (by path) holds. A file's ids take the rows of its features in order
    (``container.read_features``).
    ``container.read_strips`` takes a selection of the rows and gives their images."""
    dirs = container.read_directories(spark, paths)
    rows = container.image_rows(dirs).withColumnRenamed("id", "object_number")
    head = container.read_first(spark, paths).orderBy("path").first()
    root = run.embedded({k: bytes(v) for k, v in head["texts"].items()})
    cat = daf.definitions(root)
    names = [u.get("name") for u in root.iter("UDF") if cat.features[u.get("name")].type != "combined"]
    stored = {container.FEATURES, container.FEATURES_OLD} & set(head["numbers"])
    if not stored or not names:
        return Objects(rows, cat.remove(cat.removal(features=list(cat.features))), "object_number", "import_file")
    values = container.read_features(spark, paths, names, directories=dirs)
    if daf.OBJECT not in names:
        values = values.withColumn(daf.OBJECT, F.col("object_number"))
    return Objects(values.join(rows, ["import_file", "object_number"], "left"), cat, "object_number", "import_file")


def write_gates(gates: Strategy | Objects, path: str) -> None:
    """Definitions alone as one small file that ``read`` takes back: a template (ast, ist:
    features, regions, populations, graphs) or GatingML (xml: regions, populations, spillover)."""
    known = gates if isinstance(gates, Strategy) else Strategy(gates.catalog)
    kind = kind_of(path)
    if kind not in ("template", "gates"):
        raise ValueError(f"{path!r}: definitions alone are written as ast, ist or xml")
    if kind == "template" and known.spillover:
        raise ValueError(f"{path!r}: templates hold no spillover")
    text = daf.write_template(known.catalog) if kind == "template" else gatingml.render(known)
    store, place = place_of(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as f:
        f.write(text.encode())


def write(objects: Objects, folder: str, kind: str, **options) -> DataFrame:
    """Objects as FCS or analysis files in a folder, or, where the table has height,
    width, pixels and mask, as containers (``about``: a ``run.Run``), by the tasks that hold
    them: file, rows."""
    if kind == "fcs":
        return fcs.write_fcs(objects.values().select(*(F.col("`" + n + "`") for n in objects.catalog.features)), folder, **options)
    if kind == "daf":
        return daf.write_daf(objects, folder, **options)
    if kind == "container":
        names = [n for n, f in objects.catalog.features.items() if f.type != "combined"]
        about = replace(options.pop("about", run.Run(())), definitions=daf.write_template(objects.catalog))
        df = objects.df.withColumn("object_id", F.col("`" + objects.id_col + "`").cast("long"))
        return container.write_images(df, folder, about=about.tags(), features=names, **options)
    raise ValueError(f"objects can't be written as {kind!r}")
