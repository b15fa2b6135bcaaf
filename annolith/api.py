"""The names most programs need."""

from annolith.functions.parsing import parsed
from annolith.operators.inference import evaluate, infer, register
from annolith.operators.kg import bundle_scores, rerank
from annolith.operators.metrics import delta_table, observed_metrics, property_metrics, run_summary
from annolith.operators.order import exact_sample, row_index
from annolith.operators.ranking import holdout_split, main_vs_best, prompt_winners, quota_select
from annolith.operators.runtime import chat, with_config
from annolith.operators.segmentation import refine, refinement_run, segment, segmentation_run
from annolith.plans.pipelines import build_subset, evaluate_model, kg_posthoc, review_export, segmentation_tables, training_examples, training_split
from annolith.sources.images import read_images, read_masks, save_predictions, write_masks, write_png
from annolith.sources.prune import prune
from annolith.sources.specs import PropertySpec, dataset_context, knowledge_priors, protocol_specs, register_dataset, specs_frame
from annolith.sources.tables import annotations, listings, meta, predictions, samples
from annolith.sources.versions import VersionedTable, WorkLog

__all__ = [n for n in dir() if not n.startswith("_")]
