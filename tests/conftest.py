import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tripleweft-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    import tripleweft as tw

    yield tw.configure(session)
    session.stop()


# A small graph of painters and works, written as in an N-Triples file.
R = "http://museum.example/"
SAMPLE = [
    ("Dawn", "title", '"Dawn"@en'), ("Dusk", "title", '"Schemer"@nl'), ("Noon", "title", '"Noon"'),
    ("Ada", "born", '"1901"'), ("Bo", "born", '"1910"'), ("Cy", "born", '"1920"'),
    ("Ada", "paints", "Dawn"), ("Bo", "paints", "Dusk"), ("Bo", "paints", "Noon"),
    ("Ada", "teaches", "Bo"), ("Bo", "teaches", "Cy"), ("Cy", "teaches", "Cy"), ("Di", "teaches", "Bo"),
    ("Ada", "admires", "Bo"), ("Ada", "admires", "Di"), ("Bo", "admires", "Cy"),
    ("Eve", "admires", "Ada"), ("Eve", "admires", "Dawn"),
    ("Dawn", "hangsIn", "East"), ("Dusk", "hangsIn", "West"), ("Noon", "hangsIn", "East"),
    ("Di", "owns", "Dawn"), ("Di", "owns", "Dusk"), ("Eve", "owns", "Noon"),
]


def iri(name: str) -> str:
    return name if name.startswith(('"', "?")) else R + name


def sample_lines(sep: str = " ") -> list[str]:
    def text(name: str) -> str:
        return name if name.startswith('"') else f"<{R}{name}>"

    return [sep.join(map(text, triple)) + " ." for triple in SAMPLE]


@pytest.fixture(scope="session")
def sample(spark, tmp_path_factory):
    import tripleweft as tw

    path = tmp_path_factory.mktemp("sample") / "sample.nt"
    path.write_text("\n".join(sample_lines()) + "\n")
    return tw.read_ntriples(spark, str(path)).cache()


@pytest.fixture(scope="session")
def sample_dictionary(sample):
    import tripleweft as tw

    return tw.build_dictionary(sample).cache()


@pytest.fixture(scope="session")
def sample_enc(sample, sample_dictionary):
    import tripleweft as tw

    return tw.encode_triples(sample, sample_dictionary).cache()


def bag(df):
    """Rows as a sorted list, to compare bags."""
    return sorted((tuple(row) for row in df.collect()), key=repr)
