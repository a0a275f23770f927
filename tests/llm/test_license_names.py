from octavo.llm import license_scan

CASES = [
    ("GPLv2", "gpl"), ("under the GPLv3 or later", "gpl"), ("Licensed under the LGPLv2.1", "lgpl"), ("LGPLv3", "lgpl"), ("AGPLv3 applies", "agpl"), ("gpl3", "gpl"),
    ("Licensed under the Apache License", "apache"), ("the Apache License", "apache"), ("Licensed under the Apache License, Version 2.0", "apache"), ("apache2", "apache"),
    ("GNU Lesser General Public License", "lgpl"), ("GNU Library General Public License version 2", "lgpl"), ("under the GNU Affero General Public License, version 3", "agpl"), ("GNU General Public License, version 2", "gpl"),
    ("apache helicopters", ""), ("gplv2x", ""),
]


def test_joined_versions_and_own_labels(spark):
    from test_license import check

    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.row.doc_id: r for r in license_scan.scan(df).collect()}
    check(got.values())
    for i, (text, label) in enumerate(CASES):
        found = {d.label for d in got[i].detections or []}
        assert found == ({label} if label else set()), text
        assert (got[i].score > 0) == bool(label), text
