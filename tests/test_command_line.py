import pytest
from conftest import rows

from rankforge.__main__ import parser, run
from rankforge.session import shared_dir


def test_top_users(spark, tmp_path):
    (tmp_path / "access.log").write_text(
        "[13/Jul/2015:10] username='aaaaaaaa'\n[14/Jul/2015:10] username='bbbbbbbb'\n"
    )
    out = shared_dir(spark, "t")
    args = ["top-users", "--input-dir", str(tmp_path), "--output-dir", out, "--run-id", "r"]
    assert rows(run(spark, args)) == [("aaaaaaaa", 1), ("bbbbbbbb", 1)]
    assert rows(run(spark, [*args, "--date-from", "2015-07-14", "--format", "text"])) == [("bbbbbbbb", 1)]
    assert rows(run(spark, [*args, "--date-from", "", "--date-to", "", "--limit", "1"])) == [("aaaaaaaa", 1)]


def test_train_then_recommend(spark, tmp_path):
    ratings = "".join(f"{u},{i},{1 + (u * i) % 5},0\n" for u in range(8) for i in range(u % 3, 9))
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n" + ratings)
    items = "".join(f"{i},Title {i},Drama\n" for i in range(9))
    (tmp_path / "movies.csv").write_text("movieId,title,genres\n" + items)
    model, out = shared_dir(spark, "t"), shared_dir(spark, "t")
    assert run(spark, ["train", "--input-dir", str(tmp_path), "--model", model, "--num-blocks", "2"]) is None
    args = ["recommend", "--input-dir", f"{tmp_path}/", "--output-dir", out, "--model", model]
    default = rows(run(spark, args))
    assert len(default) == 9 and {r[0] for r in default} == {0}
    unseen = rows(run(spark, [*args, "--user-id", "2", "--candidates", "unseen", "--limit", "5"]))
    assert {r[1] for r in unseen} == {0, 1}


def test_defaults():
    args = parser().parse_args(["recommend", "--input-dir", "a", "--output-dir", "b"])
    assert (args.limit, args.user_id, args.candidates, args.run_id) == (10, 0, "rated_by_others", None)
    args = parser().parse_args(["top-users", "--input-dir", "a", "--output-dir", "b"])
    assert (args.limit, args.date_from, args.date_to, args.on_bad_date) == (10, None, None, "fail")
    with pytest.raises(SystemExit):
        parser().parse_args(["top-users", "--input-dir", "a"])
