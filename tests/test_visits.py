import pytest

from photoflow.sources import visits

FILE = """<?xml version="1.0" encoding="UTF-8"?>
<VOTABLE version="1.3" xmlns="http://www.ivoa.net/xml/VOTable/v1.3"><RESOURCE><TABLE>
{fields}
<DATA><TABLEDATA>
{rows}
</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>
"""


def written(folder, fields, rows):
    path = folder / "visits.xml"
    made = "\n".join(f'<FIELD name="{n}" ID="c{i}" datatype="{k}"{" arraysize=" + chr(34) + "*" + chr(34) if k == "char" else ""}/>' for i, (n, k) in enumerate(fields))
    path.write_text(FILE.format(fields=made, rows="\n".join("<TR>" + "".join(f"<TD>{v}</TD>" for v in r) + "</TR>" for r in rows)))
    return str(path)


def days(spark, path):
    return [r.t for r in visits.visit_times(visits.read_votable(spark, path)).collect()]


@pytest.mark.parametrize(("shift", "scale"), [(0.0, "jd"), (2400000.5, "mjd"), (None, "year")])
def test_middle_of_start_and_stop(spark, tmp_path, shift, scale):
    middles = [2457000.25, 2457100.5, 2457100.5, 2457001.0]
    told = [(m - shift if shift is not None else 2000 + (m - 2451545.0) / 365.25) for m in middles]
    wide = 0.125 if shift is not None else 0.0
    path = written(tmp_path, [("Target", "char"), ("t_start [x]", "double"), ("t_stop", "double")], [("a", t - wide, t + wide) for t in told] + [("b", "", told[0]), ("c", "NaN", 1.0)])
    rows = visits.read_votable(spark, path)
    assert rows.dtypes == [("Target", "string"), ("t_start [x]", "double"), ("t_stop", "double")] and rows.count() == 6
    assert days(spark, path) == pytest.approx([2457000.25, 2457001.0, 2457100.5], abs=1e-5)


def test_dates_and_numbers(spark, tmp_path):
    path = written(tmp_path, [("ObservationTimeAtGaia[UTC]", "char"), ("mjd", "double")], [("2014-07-25T10:30:00.000 (UTC)", 1.0), ("2014-07-24T12:00:00", 2.0), ("nonsense", 3.0)])
    assert days(spark, path) == pytest.approx([2456863.0, 2456863.9375], abs=1e-6)
    assert days(spark, written(tmp_path, [("flux", "float"), ("Obs Time", "double")], [(5.0, 57000.0), (6.0, 57000.0), (7.0, 56000.5)])) == [2456001.0, 2457000.5]
    with pytest.raises(ValueError, match="no column"):
        days(spark, written(tmp_path, [("flux", "float"), ("time", "double")], [(5.0, 17.0)]))
    with pytest.raises(ValueError, match="unit"):
        days(spark, written(tmp_path, [("start", "double"), ("stop", "double")], [(5.0, 17.0)]))
    (tmp_path / "empty.xml").write_text("<VOTABLE></VOTABLE>")
    with pytest.raises(ValueError, match="FIELD"):
        visits.read_votable(spark, str(tmp_path / "empty.xml"))
