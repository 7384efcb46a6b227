"""Schemas of the tables, as DDL; readers never infer."""

from __future__ import annotations

STATION = (
    "stationuuid string, name string, url string, url_resolved string, country string, countrycode string, language string, "
    "language_canonical string, tags string, codec string, bitrate int, votes int, homepage string"
)
RECORDING = (
    f"station struct<{STATION.replace(' string', ':string').replace(' int', ':int')}>, filepath string, duration_actual double, file_size_bytes bigint, "
    "started_at string, completed_at string, success boolean, error string, avg_bitrate_kbps double, silence_ratio double, peak_amplitude double"
)
PROBE = "ok:boolean,error:string,stderr:string,streams:array<struct<codec_name:string,codec_type:string,sample_rate:string,channels:int,bits_per_sample:int,bits_per_raw_sample:string>>,format:struct<duration:string,bit_rate:string,format_name:string>"
CATALOG = (
    "id string, name string, country_code string, homepage string, source_page string, stream_url string, content_type string, language string, discovered_via string, "
    "technical_status string, rights_status string, rights_notes string, probe struct<codec:string,sample_rate_hz:int,channels:int,bitrate_bps:int,format:string,bits_per_sample:int>"
)
MANIFEST = (
    "source struct<id:string,name:string,country_code:string,rights_status:string,probe:struct<sample_rate_hz:int>>, "
    "capture struct<started_at:string,completed_at:string,duration_requested_seconds:int,elapsed_seconds:double,ffmpeg_returncode:int,ffmpeg_error:string>, "
    "local struct<audio_path:string,metadata_path:string,file_size_bytes:bigint>, "
    f"quality struct<valid:boolean,validation_message:string,source_sample_rate_hz:int,target_sample_rate_hz:int,target_bit_depth:int,output_probe:struct<{PROBE}>>, "
    "gcs struct<bucket:string,audio_uri:string,metadata_uri:string,audio_upload:struct<ok:boolean>,metadata_upload:struct<ok:boolean>>, _corrupt_record string"
)
UNIT = (
    "audio struct<bytes:binary,path:string>, text string, iu_id string, segment_id string, source_id string, source_name string, country_code string, recording_date string, "
    "started_at string, rights_status string, segment_duration_seconds double, iu_index int, start_seconds double, end_seconds double, duration_seconds double, start_word_index int, "
    "end_word_index_exclusive int, boundary_after_word_index int, alignment_score double, alignment_method string, iu_word_count int, speech_rate_wps double, mean_energy_db double, "
    "pause_before_ms double, pause_after_ms double, boundary_strength string, words_json string, manifest_path string"
)
SEGMENT = (
    "segment_id string, source_id string, source_name string, country_code string, recording_date string, started_at string, duration_seconds double, audio_path string, asr_text string, "
    "words array<struct<word:string,start_seconds:double,end_seconds:double,word_index:int,timestamp_source:string>>, "
    "boundaries array<struct<iu_index:int,text:string,start_seconds:double,end_seconds:double,start_word_index:int,end_word_index_exclusive:int,boundary_after_word_index:int,"
    "alignment_score:double,alignment_method:string,prosody:struct<iu_word_count:int,speech_rate_wps:double,mean_energy_db:double,pause_before_ms:double,pause_after_ms:double,boundary_strength:string>>>, "
    "status string, manifest_path string"
)
ANNOTATION = "iu_id string, annotator string, emotion string, confidence int, low_quality int, notes string, created_at string, updated_at string, seq bigint"
SEEN = "user_key string, iu_id string, seen_at string, seq bigint"
RETRANSCRIPT = "iu_id string, text string, old_text string, duration_seconds double, source_id string, decoded_at string, elapsed_seconds double, model_id string, device string, seq bigint"
EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
