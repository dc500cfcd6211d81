from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import vectors as vx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, tx.tokens(F.col("t")), t="Ünï-code the_x 42, The end.") == ["ünï", "code", "the_x", "42", "the", "end"]
    assert one(spark, tx.tokens(F.col("t"), tx.INDEX_STOP), t="The cat is on THE mat") == ["cat", "mat"]
    assert one(spark, tx.blank_tokens(F.col("t")), t="  A b\n\tC ") == ["a", "b", "c"]
    assert one(spark, tx.tokens(F.col("t")), t=None) is None
    assert len(tx.INDEX_STOP) == 46 and len(tx.QUESTION_STOP) == 27


def test_sentences_and_clean(spark):
    assert one(spark, tx.sentences(F.col("t")), t="One. Two!  Three? four.five ") == ["One.", "Two!", "Three?", "four.five"]
    assert one(spark, tx.clean(F.col("t")), t=" a\r\nb\n\n\n\nc \t d \n") == "a\nb\n\nc d"


def test_html(spark):
    page = "<html><style>p{}</style><SCRIPT src=x>var a = '<b>';</SCRIPT><p>Hello &amp;amp; world&nbsp;&lt;x&gt;</p>"
    assert one(spark, tx.html_to_text(F.col("t")), t=page) == "Hello &amp; world <x>"


def test_html_entities(spark):
    page = "<p>caf&eacute; &#8217;&#xE9;&#X41; 5 &euro;&nbsp;&uuml;ber &notin; ver&amp Erst &copy2 &lt;b&gt; &amp;eacute;&emsp;&unknown; &</p>"
    assert one(spark, tx.html_to_text(F.col("t")), t=page) == "café ’éA 5 € über ∉ ver& Erst ©2 <b> &eacute; &unknown; &"
    assert one(spark, tx.html_to_text(F.col("t")), t=None) is None


def test_vectors(spark):
    assert one(spark, vx.dot(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == 11.0
    assert one(spark, vx.unit(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, vx.unit(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vx.squared_distance(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == 8.0
