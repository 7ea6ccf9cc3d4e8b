"""Record layouts of trial files, as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def text_columns(*names: str) -> T.StructType:
    """Header CSV as written: every value is text until it is typed on purpose."""
    return T.StructType([T.StructField(n, _S) for n in names])


# Column orders of the recorded files.
TELEMETRY = (
    "frame", "t_capture", "t_thermal", "t_bird", "t_flir_visible", "t", "gripper_pos",
    "goal_gripper_pos", "present_current", "present_load", "present_temperature",
)
LABELLED = (
    "frame", "t_capture", "t_thermal", "t_bird", "t_flir_visible", "surface", "contact", "phase",
    "sweep_progress",
)
FEATURES = ("frame", "area_px", "mean_delta", "max_delta")
SAMPLE_POINTS = ("oak_x", "oak_y", "oak_z", "ir_x", "ir_y")
SAMPLE_TIMING = ("oak_observed_at_s", "thermal_observed_at_s", "sensor_skew_s")
SHADOW_LOG = (
    "schema_version", "tick", "control_observed_at_s", "oak_observed_at_s", "thermal_observed_at_s",
    "sensor_skew_ms", "oak_age_ms", "thermal_age_ms", "loop_period_ms", "control_latency_ms", "state",
    "pinch", "roi_mode", "roi_x", "roi_y", "roi_width", "roi_height", "baseline_ready", "pressure",
    "quality", "pressure_available", "pressure_status", "base_gripper_pos", "proposed_gripper_pos",
    "actual_gripper_pos", "command_sent", "fault_latched", "fallback_used", "fallback_reason",
)

# Field names and types of a trial's metadata document.
TRIAL_METADATA = _struct(
    trial_id=_S, object_name=_S, hardness=_S, grip_level=_S, rep=_I, warmed=_B, thermal_path=_S,
    flir_visible_path=_S, thermal_stream_kind=_S, thermal_roi=_S,
)
REGION = _struct(x=_I, y=_I, width=_I, height=_I)
# Field names and types of a raw frame's sidecar.
RAW_SIDECAR = _struct(
    frame_index=_L, monotonic_timestamp_ns=_L, width=_I, height=_I, dtype=_S, byte_order=_S, raw_file=_S,
    ffc_state=_S, repeated_frame_flag=_B, raw_min=_I, raw_median=_I, raw_max=_I,
    display_mapping=_struct(mode=_S, raw_low=_I, raw_high=_I),
)
# Field names and types of a stored projection calibration.
CALIBRATION = _struct(
    version=_I, coeff_x=T.ArrayType(_D), coeff_y=T.ArrayType(_D), image_size=T.ArrayType(_I),
    rms_error_px=_D, max_error_px=_D, sample_count=_I,
)
# Field names and types of a session row's fingertip.
_TIP = _struct(
    label=_S, thermal_raw_count=_D, thermal_patch_3x3_mean_count=_D, thermal_uv=T.ArrayType(_D),
    thermal_pixel=T.ArrayType(_I), depth_m=_D, color_pixel=T.ArrayType(_I), depth_pixel=T.ArrayType(_I),
)
# Field names and types of rows of a pinch session log.
PINCH_SESSION = _struct(
    row_type=_S, status=_S, schema_version=_I, safety_mode=_S, stage0_runtime_sha256=_S, frozen_xml_sha256=_S,
    pinch_signal_started=_B, pinch_signal_protocol_completed=_B, pinch_signal_acquisition_blocked=_B,
    pinch_signal_valid_groups=_I, pinch_signal_invalid_groups=_I,
    pinch_signal=_struct(
        recording=_B, quota_accepted=_B, quota_reasons=T.ArrayType(_S), target_valid_samples=_I,
        group_index=_I, phase=_S, label=_S,
    ),
    thermal_frame_median_count=_D, thermal_pinch_center_uv=T.ArrayType(_D), pinch_center_shift_px=_D,
    thermal_patches_overlap=_B,
    pinch_geometry=_struct(valid=_B, reason=_S, pinch_distance_2d_norm=_D, pinch_depth_delta_m=_D),
    fingertips=T.ArrayType(_TIP),
)
# Field names and types of rows of a finger session log.
FINGER_SESSION = _struct(
    row_type=_S, trial_index=_I, block_index=_I, condition=_S, order_in_block=_I, reserve=_B, phase=_S,
    phase_elapsed_s=_D, global_elapsed_s=_D, frame_index=_I, thermal_host_s=_D, ffc_state=_S,
    ffc_in_progress=_B, tlinear_enabled=_S, tlinear_resolution_k=_D, tracking_valid=_S,
    tracking_reasons=T.ArrayType(_S), artifact_write_ok=_S, distal_thermal_u_px=_D, distal_thermal_v_px=_D,
    distal_depth_m=_D, primary_signal_count=_D, experiment_identity=_S,
    frame_artifacts=_struct(thermal_uint16=_S, d435_rgb=_S, d435_depth_z16=_S),
)
