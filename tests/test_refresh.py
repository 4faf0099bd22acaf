"""Registries of a made tree, and data cards."""

import json

from assayer.operators import refresh


def test_refresh(spark, tmp_path):
    made = {
        "qc/D501.qc.json": {"report_key": "Dataset501_Teeth", "summary": {"dataset_status": "fail", "case_count": 3, "error_count": 2}}, "qc/other.qc.json": {"summary": {}}, "qc/broken.qc.json": "no json",
        "raw/Dataset501_Teeth/dataset.json": {"name": "Teeth", "labels": {"background": 0, "tooth": 1}, "file_ending": ".png"}, "raw/Dataset501_Teeth/imagesTr/a_0000.png": "x", "raw/Dataset501_Teeth/labelsTr/a.png": "x",
        "raw/Dataset501_Teeth/imagesTr/deep/b.png": "x", "raw/Dataset502_Bare/imagesTr/a.png": "x", "raw/notes.txt": "x", "reports/nnUNet_delivery_Dataset501_Teeth.json": {"task": "teeth"},
        "reports/nnUNet_delivery_Dataset501_Teeth.status.json": {"status": "completed", "stage": "done", "task": "teeth"}, "results/Dataset501_Teeth/fold_0/checkpoint_best.pth": "x", "results/Dataset777_Gone/model.pth": "x", "results/other.pth": "x",
        "runs/r1/run_status.json": {"status": "running", "stage": "search", "completed_trials": 2}, "runs/r1/launcher_status.json": {"status": "started", "pid": 7}, "runs/r2/run_status.json": {"status": "failed", "error": "out of memory"},
        "runs/r3/run_summary.json": {"best_model_export_path": "/m/Dataset501_Teeth/best.pth", "best_model": {"model_name": "unet", "metrics": {"mean_dice": 0.9}}, "inference": {"mean_dice": 0.8}}, "runs/r4/run_summary.json": {},
    }
    for name, data in made.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(data if isinstance(data, str) else json.dumps(data))
    tables = refresh.refresh(spark, f"{tmp_path}/in")
    qc = {r["report_key"]: r for r in tables["dataset_qc_reports"].collect()}
    assert set(qc) == {"Dataset501_Teeth", "other"} and (qc["Dataset501_Teeth"]["status"], qc["Dataset501_Teeth"]["error_count"]) == ("fail", 2)
    d = {r["folder_name"]: r for r in tables["datasets"].collect()}
    a = d["Dataset501_Teeth"]
    assert set(d) == {"Dataset501_Teeth", "Dataset502_Bare"} and (a["dataset_id"], a["imagesTr"], a["labelsTr"], a["n_labels"], a["label_names_preview"], a["ready"]) == (501, 1, 1, 1, ["tooth"], True)
    assert (a["delivery_status"], a["task"], a["qc_status"]) == ("completed", "teeth", "fail") and not d["Dataset502_Bare"]["ready"]
    m = {r["model_path"].rsplit("/")[-1]: r for r in tables["models"].collect()}
    assert set(m) == {"checkpoint_best.pth", "model.pth", "best.pth"} and (m["best.pth"]["mean_dice"], m["best.pth"]["test_mean_dice"], m["checkpoint_best.pth"]["dataset_id"]) == (0.9, 0.8, 501)
    runs = {(r["kind"], r["run_id"]): r for r in tables["task_runs"].collect()}
    assert (runs["experimentation_run", "r1"]["launcher_pid"], runs["experimentation_run", "r2"]["launcher_status"], runs["experimentation_summary", "r3"]["status"]) == (7, None, "completed")
    assert runs["dataset_export", "nnUNet_delivery_Dataset501_Teeth"]["task_id"] == "teeth" and len(runs) == 5
    assert {r["model_path"].rsplit("/")[-1] for r in tables["lineage"].collect()} == {"checkpoint_best.pth", "best.pth"}
    refresh.write_registry(tables, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/models").count() == 3
    text = (tmp_path / "out" / "overview.md").read_text()
    assert "- QC failures: 1\n- Running tasks: 1\n- Failed tasks: 1" in text and "error=out of memory" in text


def test_data_card(spark):
    schema = "split string, case_id string, kind string, status string, shape array<int>, label_values array<int>, patient_id string"
    rows = [("train", "a", "image", "ok", [4, 4], None, "p"), ("train", "a", "mask", "ok", [4, 5], [0, 2], None), ("test", "a", "image", "ok", [4, 4], None, "p"), ("test", "b", "mask", "unreadable", None, None, None)]
    card = refresh.data_card(spark.createDataFrame(rows, schema), "m1")
    assert card["split_summary"] == {"test": {"image_count": 1, "mask_count": 1}, "train": {"image_count": 1, "mask_count": 1}} and card["label_values_observed"] == [0, 2]
    assert (card["image_mask_shape_mismatch_count"], card["unreadable_file_count"], card["patient_split_check"], card["annotation_description"]) == (1, 1, "fail", "pixel masks")
    again = refresh.data_card(spark.createDataFrame(rows[::-1], schema), "m1")
    assert again == card and "p" not in json.dumps({k: v for k, v in card.items() if k not in ("image_type", "card_sha256")}).split('"')
    empty = refresh.data_card(spark.createDataFrame([], schema), "m2", "d")
    assert (empty["dataset_id"], empty["patient_split_check"], empty["split_summary"]) == ("d", "not_available", {})
