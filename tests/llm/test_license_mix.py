"""Files with several licences keep the label of each."""
from mediaframe.llm import license_scan
from tests.llm.fixtures import documents

PASSAGE = {}
for _label, _passage, _ in license_scan.PASSAGES:
    PASSAGE.setdefault(_label, _passage)


def test_no_licence_crowds_out_another(spark):
    bsd, apache, mit = PASSAGE["bsd"], PASSAGE["apache"], PASSAGE["mit"]
    mixed = [
        (1, f"{bsd}. And more: released under the MIT license", "bsd,mit"),
        (2, f"{mit}\n\n{bsd}\n\n{apache}", "apache,bsd,mit"),
        (3, f"{PASSAGE['unlicense']} x {PASSAGE['mpl']} x {apache}", "apache,mpl,unlicense"),
        (4, " then ".join(PASSAGE.values()), ",".join(sorted({*PASSAGE, "gpl"}))),
        (5, f"{bsd} and the words mit license alone", "bsd"),
    ]
    # Single licence lines make the other words rare or common, as in a corpus.
    corpus = [(i, t) for i, t, _ in mixed] + [(100 + i, p) for i, p in enumerate(list(PASSAGE.values()) * 3)]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(documents(spark, corpus)).collect()}
    want = {i: x for i, _, x in mixed}
    assert {i: got[i] for i in want} == want
