import numpy as np

from tidemark import schema
from tidemark.__main__ import main
from tidemark.sources import tables


def test_stages_from_videos_to_figures(spark, tmp_path, capsys):
    """Two series of frames, one of which has a clip in it, through every stage."""
    rng = np.random.default_rng(3)
    clip = rng.integers(0, 255, (20, 16, 16))
    tv = rng.integers(0, 255, (60, 16, 16))
    tv[20:40] = clip
    for folder, name, frames in (("tv", "news.mp4", tv), ("commercials", "soap.mp4", clip), ("commercials", "tea.mp4", rng.integers(0, 255, (20, 16, 16)))):
        (tmp_path / folder).mkdir(exist_ok=True)
        with open(tmp_path / folder / name, "wb") as f:  # arrays under a video's name, for the decoder of arrays
            np.savez(f, fps=3.0, frames=frames)
    out = str(tmp_path / "out")
    pre = ["preprocess", "--tv_dir", f"{tmp_path}/tv", "--commercials_dir", f"{tmp_path}/commercials", "--output_dir", out, "--grid_size", "16", "--decoder", "tidemark.sources.video:npz_decoder"]
    main(pre)
    manifest = {r["video"]: r for r in spark.read.json(f"{out}/manifest").selectExpr("*", "regexp_extract(source_path, '([^/]*).mp4', 1) as video").collect()}
    assert {k: (r["category"], r["num_frames"], r["duration_sec"], r["feature_dim"]) for k, r in manifest.items()} == {"news": ("tv", 60, 20.0, 268), "soap": ("commercials", 20, 20 / 3, 268), "tea": ("commercials", 20, 20 / 3, 268)}
    main(pre)  # all are there: nothing is done again
    main(["curves", "--input_dir", out, "--output_dir", f"{out}/curves"])
    main(["knn", "--input_dir", out, "--output_dir", f"{out}/knn", "--k", "2", "--normalize"])
    # another video, and every stage again: what is there stays, and manifests have all
    with open(tmp_path / "tv" / "late, show.mp4", "wb") as f:
        np.savez(f, fps=3.0, frames=tv[10:50])
    capsys.readouterr()
    main(pre)
    main(["curves", "--input_dir", out, "--output_dir", f"{out}/curves"])
    main(["knn", "--input_dir", out, "--output_dir", f"{out}/knn", "--k", "2", "--normalize", "--batch_size", "7"])
    videos = tables.latest(tables.read_manifest(spark, f"{out}/manifest"), "key").collect()
    assert sorted((r["key"], r["num_frames"]) for r in videos) == [("commercials::soap", 20), ("commercials::tea", 20), ("tv::late, show", 40), ("tv::news", 60)]
    curves = tables.read_manifest(spark, tables.manifest_of(f"{out}/curves"), schema.CURVE_FILES).collect()
    assert sorted((r["category"], r["video"], r["frames"]) for r in curves) == [("commercials", "soap", 20), ("commercials", "tea", 20), ("tv", "late, show", 40), ("tv", "news", 60)]
    assert sorted(r["tv_video"] for r in tables.read_manifest(spark, tables.manifest_of(f"{out}/knn"), schema.NEIGHBOUR_FILES).collect()) == ["late, show", "news"]
    assert "no entry" not in capsys.readouterr().out and spark.read.parquet(f"{out}/knn").select("video").distinct().count() == 2
    main(["detect_knn", "--knn_dir", f"{out}/knn", "--manifest", f"{out}/manifest", "--curve_dir", f"{out}/curves", "--curve_threshold", "0", "--output", f"{out}/knn_found", "--offset_tolerance", "3.0", "--coverage_ratio", "0.5", "--min_gap", "4", "--include_score", "--score_threshold", "0.9"])
    main(["detect_curves", "--curves_dir", f"{out}/curves", "--preproc_manifest", f"{out}/manifest", "--output", f"{out}/curves_found", "--z_threshold", "0.5", "--min_peak_sec", "0.3", "--match_threshold", "0.2"])
    (tmp_path / "truth.txt").write_text("news\t6.667\t6.667\tsoap\n")
    capsys.readouterr()
    main(["evaluate", f"{out}/knn_found", f"{tmp_path}/truth.txt"])
    lines = capsys.readouterr().out.splitlines()
    assert any(x.startswith(" OK) news ") and " soap " in x for x in lines) and "ok=1" in lines[-1] and "total=1" in lines[-1]
