"""Message dialects: what a decoder must know of each message id.

A dialect is computed from message definitions (public XML files or the texts below): the checksum seed of a message is the
checksum of its name and its fields in wire order (largest types first, extension fields left out), folded to a byte; the
payload bounds are the sizes without and with extensions. Load a full dialect with ``from_xml``.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass
from pathlib import Path

from skytally.codec.crc import mcrf4xx

SIZES = {"char": 1, "int8_t": 1, "uint8_t": 1, "int16_t": 2, "uint16_t": 2, "int32_t": 4, "uint32_t": 4, "float": 4, "int64_t": 8, "uint64_t": 8, "double": 8}

#: Public definitions of the messages that autopilots commonly send, and of those that the library itself reads
#: or writes; "|" begins extension fields.
CORE = """
0 HEARTBEAT uint8_t:type,autopilot,base_mode uint32_t:custom_mode uint8_t:system_status,mavlink_version
1 SYS_STATUS uint32_t:onboard_control_sensors_present,onboard_control_sensors_enabled,onboard_control_sensors_health uint16_t:load,voltage_battery int16_t:current_battery int8_t:battery_remaining uint16_t:drop_rate_comm,errors_comm,errors_count1,errors_count2,errors_count3,errors_count4 | uint32_t:onboard_control_sensors_present_extended,onboard_control_sensors_enabled_extended,onboard_control_sensors_health_extended
2 SYSTEM_TIME uint64_t:time_unix_usec uint32_t:time_boot_ms
4 PING uint64_t:time_usec uint32_t:seq uint8_t:target_system,target_component
5 CHANGE_OPERATOR_CONTROL uint8_t:target_system,control_request,version char[25]:passkey
6 CHANGE_OPERATOR_CONTROL_ACK uint8_t:gcs_system_id,control_request,ack
7 AUTH_KEY char[32]:key
8 LINK_NODE_STATUS uint64_t:timestamp uint8_t:tx_buf,rx_buf uint32_t:tx_rate,rx_rate uint16_t:rx_parse_err,tx_overflows,rx_overflows uint32_t:messages_sent,messages_received,messages_lost
11 SET_MODE uint8_t:target_system,base_mode uint32_t:custom_mode
20 PARAM_REQUEST_READ uint8_t:target_system,target_component char[16]:param_id int16_t:param_index
21 PARAM_REQUEST_LIST uint8_t:target_system,target_component
22 PARAM_VALUE char[16]:param_id float:param_value uint8_t:param_type uint16_t:param_count,param_index
23 PARAM_SET uint8_t:target_system,target_component char[16]:param_id float:param_value uint8_t:param_type
24 GPS_RAW_INT uint64_t:time_usec uint8_t:fix_type int32_t:lat,lon,alt uint16_t:eph,epv,vel,cog uint8_t:satellites_visible | int32_t:alt_ellipsoid uint32_t:h_acc,v_acc,vel_acc,hdg_acc uint16_t:yaw
25 GPS_STATUS uint8_t:satellites_visible uint8_t[20]:satellite_prn,satellite_used,satellite_elevation,satellite_azimuth,satellite_snr
26 SCALED_IMU uint32_t:time_boot_ms int16_t:xacc,yacc,zacc,xgyro,ygyro,zgyro,xmag,ymag,zmag | int16_t:temperature
27 RAW_IMU uint64_t:time_usec int16_t:xacc,yacc,zacc,xgyro,ygyro,zgyro,xmag,ymag,zmag | uint8_t:id int16_t:temperature
28 RAW_PRESSURE uint64_t:time_usec int16_t:press_abs,press_diff1,press_diff2,temperature
29 SCALED_PRESSURE uint32_t:time_boot_ms float:press_abs,press_diff int16_t:temperature | int16_t:temperature_press_diff
30 ATTITUDE uint32_t:time_boot_ms float:roll,pitch,yaw,rollspeed,pitchspeed,yawspeed
31 ATTITUDE_QUATERNION uint32_t:time_boot_ms float:q1,q2,q3,q4,rollspeed,pitchspeed,yawspeed | float[4]:repr_offset_q
32 LOCAL_POSITION_NED uint32_t:time_boot_ms float:x,y,z,vx,vy,vz
33 GLOBAL_POSITION_INT uint32_t:time_boot_ms int32_t:lat,lon,alt,relative_alt int16_t:vx,vy,vz uint16_t:hdg
34 RC_CHANNELS_SCALED uint32_t:time_boot_ms uint8_t:port int16_t:chan1_scaled,chan2_scaled,chan3_scaled,chan4_scaled,chan5_scaled,chan6_scaled,chan7_scaled,chan8_scaled uint8_t:rssi
35 RC_CHANNELS_RAW uint32_t:time_boot_ms uint8_t:port uint16_t:chan1_raw,chan2_raw,chan3_raw,chan4_raw,chan5_raw,chan6_raw,chan7_raw,chan8_raw uint8_t:rssi
36 SERVO_OUTPUT_RAW uint32_t:time_usec uint8_t:port uint16_t:servo1_raw,servo2_raw,servo3_raw,servo4_raw,servo5_raw,servo6_raw,servo7_raw,servo8_raw | uint16_t:servo9_raw,servo10_raw,servo11_raw,servo12_raw,servo13_raw,servo14_raw,servo15_raw,servo16_raw
37 MISSION_REQUEST_PARTIAL_LIST uint8_t:target_system,target_component int16_t:start_index,end_index | uint8_t:mission_type
38 MISSION_WRITE_PARTIAL_LIST uint8_t:target_system,target_component int16_t:start_index,end_index | uint8_t:mission_type
39 MISSION_ITEM uint8_t:target_system,target_component uint16_t:seq uint8_t:frame uint16_t:command uint8_t:current,autocontinue float:param1,param2,param3,param4,x,y,z | uint8_t:mission_type
40 MISSION_REQUEST uint8_t:target_system,target_component uint16_t:seq | uint8_t:mission_type
41 MISSION_SET_CURRENT uint8_t:target_system,target_component uint16_t:seq
42 MISSION_CURRENT uint16_t:seq | uint16_t:total uint8_t:mission_state,mission_mode uint32_t:mission_id,fence_id,rally_points_id
43 MISSION_REQUEST_LIST uint8_t:target_system,target_component | uint8_t:mission_type
44 MISSION_COUNT uint8_t:target_system,target_component uint16_t:count | uint8_t:mission_type uint32_t:opaque_id
45 MISSION_CLEAR_ALL uint8_t:target_system,target_component | uint8_t:mission_type
46 MISSION_ITEM_REACHED uint16_t:seq
47 MISSION_ACK uint8_t:target_system,target_component,type | uint8_t:mission_type uint32_t:opaque_id
48 SET_GPS_GLOBAL_ORIGIN uint8_t:target_system int32_t:latitude,longitude,altitude | uint64_t:time_usec
49 GPS_GLOBAL_ORIGIN int32_t:latitude,longitude,altitude | uint64_t:time_usec
50 PARAM_MAP_RC uint8_t:target_system,target_component char[16]:param_id int16_t:param_index uint8_t:parameter_rc_channel_index float:param_value0,scale,param_value_min,param_value_max
51 MISSION_REQUEST_INT uint8_t:target_system,target_component uint16_t:seq | uint8_t:mission_type
54 SAFETY_SET_ALLOWED_AREA uint8_t:target_system,target_component,frame float:p1x,p1y,p1z,p2x,p2y,p2z
55 SAFETY_ALLOWED_AREA uint8_t:frame float:p1x,p1y,p1z,p2x,p2y,p2z
61 ATTITUDE_QUATERNION_COV uint64_t:time_usec float[4]:q float:rollspeed,pitchspeed,yawspeed float[9]:covariance
62 NAV_CONTROLLER_OUTPUT float:nav_roll,nav_pitch int16_t:nav_bearing,target_bearing uint16_t:wp_dist float:alt_error,aspd_error,xtrack_error
63 GLOBAL_POSITION_INT_COV uint64_t:time_usec uint8_t:estimator_type int32_t:lat,lon,alt,relative_alt float:vx,vy,vz float[36]:covariance
64 LOCAL_POSITION_NED_COV uint64_t:time_usec uint8_t:estimator_type float:x,y,z,vx,vy,vz,ax,ay,az float[45]:covariance
65 RC_CHANNELS uint32_t:time_boot_ms uint8_t:chancount uint16_t:chan1_raw,chan2_raw,chan3_raw,chan4_raw,chan5_raw,chan6_raw,chan7_raw,chan8_raw,chan9_raw,chan10_raw,chan11_raw,chan12_raw,chan13_raw,chan14_raw,chan15_raw,chan16_raw,chan17_raw,chan18_raw uint8_t:rssi
66 REQUEST_DATA_STREAM uint8_t:target_system,target_component,req_stream_id uint16_t:req_message_rate uint8_t:start_stop
67 DATA_STREAM uint8_t:stream_id uint16_t:message_rate uint8_t:on_off
69 MANUAL_CONTROL uint8_t:target int16_t:x,y,z,r uint16_t:buttons | uint16_t:buttons2 uint8_t:enabled_extensions int16_t:s,t,aux1,aux2,aux3,aux4,aux5,aux6
70 RC_CHANNELS_OVERRIDE uint8_t:target_system,target_component uint16_t:chan1_raw,chan2_raw,chan3_raw,chan4_raw,chan5_raw,chan6_raw,chan7_raw,chan8_raw | uint16_t:chan9_raw,chan10_raw,chan11_raw,chan12_raw,chan13_raw,chan14_raw,chan15_raw,chan16_raw,chan17_raw,chan18_raw
73 MISSION_ITEM_INT uint8_t:target_system,target_component uint16_t:seq uint8_t:frame uint16_t:command uint8_t:current,autocontinue float:param1,param2,param3,param4 int32_t:x,y float:z | uint8_t:mission_type
74 VFR_HUD float:airspeed,groundspeed int16_t:heading uint16_t:throttle float:alt,climb
75 COMMAND_INT uint8_t:target_system,target_component,frame uint16_t:command uint8_t:current,autocontinue float:param1,param2,param3,param4 int32_t:x,y float:z
76 COMMAND_LONG uint8_t:target_system,target_component uint16_t:command uint8_t:confirmation float:param1,param2,param3,param4,param5,param6,param7
77 COMMAND_ACK uint16_t:command uint8_t:result | uint8_t:progress int32_t:result_param2 uint8_t:target_system,target_component
81 MANUAL_SETPOINT uint32_t:time_boot_ms float:roll,pitch,yaw,thrust uint8_t:mode_switch,manual_override_switch
82 SET_ATTITUDE_TARGET uint32_t:time_boot_ms uint8_t:target_system,target_component,type_mask float[4]:q float:body_roll_rate,body_pitch_rate,body_yaw_rate,thrust | float[3]:thrust_body
83 ATTITUDE_TARGET uint32_t:time_boot_ms uint8_t:type_mask float[4]:q float:body_roll_rate,body_pitch_rate,body_yaw_rate,thrust
84 SET_POSITION_TARGET_LOCAL_NED uint32_t:time_boot_ms uint8_t:target_system,target_component,coordinate_frame uint16_t:type_mask float:x,y,z,vx,vy,vz,afx,afy,afz,yaw,yaw_rate
85 POSITION_TARGET_LOCAL_NED uint32_t:time_boot_ms uint8_t:coordinate_frame uint16_t:type_mask float:x,y,z,vx,vy,vz,afx,afy,afz,yaw,yaw_rate
86 SET_POSITION_TARGET_GLOBAL_INT uint32_t:time_boot_ms uint8_t:target_system,target_component,coordinate_frame uint16_t:type_mask int32_t:lat_int,lon_int float:alt,vx,vy,vz,afx,afy,afz,yaw,yaw_rate
87 POSITION_TARGET_GLOBAL_INT uint32_t:time_boot_ms uint8_t:coordinate_frame uint16_t:type_mask int32_t:lat_int,lon_int float:alt,vx,vy,vz,afx,afy,afz,yaw,yaw_rate
89 LOCAL_POSITION_NED_SYSTEM_GLOBAL_OFFSET uint32_t:time_boot_ms float:x,y,z,roll,pitch,yaw
90 HIL_STATE uint64_t:time_usec float:roll,pitch,yaw,rollspeed,pitchspeed,yawspeed int32_t:lat,lon,alt int16_t:vx,vy,vz,xacc,yacc,zacc
91 HIL_CONTROLS uint64_t:time_usec float:roll_ailerons,pitch_elevator,yaw_rudder,throttle,aux1,aux2,aux3,aux4 uint8_t:mode,nav_mode
92 HIL_RC_INPUTS_RAW uint64_t:time_usec uint16_t:chan1_raw,chan2_raw,chan3_raw,chan4_raw,chan5_raw,chan6_raw,chan7_raw,chan8_raw,chan9_raw,chan10_raw,chan11_raw,chan12_raw uint8_t:rssi
93 HIL_ACTUATOR_CONTROLS uint64_t:time_usec float[16]:controls uint8_t:mode uint64_t:flags
100 OPTICAL_FLOW uint64_t:time_usec uint8_t:sensor_id int16_t:flow_x,flow_y float:flow_comp_m_x,flow_comp_m_y uint8_t:quality float:ground_distance | float:flow_rate_x,flow_rate_y
101 GLOBAL_VISION_POSITION_ESTIMATE uint64_t:usec float:x,y,z,roll,pitch,yaw | float[21]:covariance uint8_t:reset_counter
102 VISION_POSITION_ESTIMATE uint64_t:usec float:x,y,z,roll,pitch,yaw | float[21]:covariance uint8_t:reset_counter
103 VISION_SPEED_ESTIMATE uint64_t:usec float:x,y,z | float[9]:covariance uint8_t:reset_counter
104 VICON_POSITION_ESTIMATE uint64_t:usec float:x,y,z,roll,pitch,yaw | float[21]:covariance
105 HIGHRES_IMU uint64_t:time_usec float:xacc,yacc,zacc,xgyro,ygyro,zgyro,xmag,ymag,zmag,abs_pressure,diff_pressure,pressure_alt,temperature uint16_t:fields_updated | uint8_t:id
106 OPTICAL_FLOW_RAD uint64_t:time_usec uint8_t:sensor_id uint32_t:integration_time_us float:integrated_x,integrated_y,integrated_xgyro,integrated_ygyro,integrated_zgyro int16_t:temperature uint8_t:quality uint32_t:time_delta_distance_us float:distance
107 HIL_SENSOR uint64_t:time_usec float:xacc,yacc,zacc,xgyro,ygyro,zgyro,xmag,ymag,zmag,abs_pressure,diff_pressure,pressure_alt,temperature uint32_t:fields_updated | uint8_t:id
108 SIM_STATE float:q1,q2,q3,q4,roll,pitch,yaw,xacc,yacc,zacc,xgyro,ygyro,zgyro,lat,lon,alt,std_dev_horz,std_dev_vert,vn,ve,vd | int32_t:lat_int,lon_int
109 RADIO_STATUS uint8_t:rssi,remrssi,txbuf,noise,remnoise uint16_t:rxerrors,fixed
110 FILE_TRANSFER_PROTOCOL uint8_t:target_network,target_system,target_component uint8_t[251]:payload
111 TIMESYNC int64_t:tc1,ts1 | uint8_t:target_system,target_component
112 CAMERA_TRIGGER uint64_t:time_usec uint32_t:seq
113 HIL_GPS uint64_t:time_usec uint8_t:fix_type int32_t:lat,lon,alt uint16_t:eph,epv,vel int16_t:vn,ve,vd uint16_t:cog uint8_t:satellites_visible | uint8_t:id uint16_t:yaw
114 HIL_OPTICAL_FLOW uint64_t:time_usec uint8_t:sensor_id uint32_t:integration_time_us float:integrated_x,integrated_y,integrated_xgyro,integrated_ygyro,integrated_zgyro int16_t:temperature uint8_t:quality uint32_t:time_delta_distance_us float:distance
115 HIL_STATE_QUATERNION uint64_t:time_usec float[4]:attitude_quaternion float:rollspeed,pitchspeed,yawspeed int32_t:lat,lon,alt int16_t:vx,vy,vz uint16_t:ind_airspeed,true_airspeed int16_t:xacc,yacc,zacc
116 SCALED_IMU2 uint32_t:time_boot_ms int16_t:xacc,yacc,zacc,xgyro,ygyro,zgyro,xmag,ymag,zmag | int16_t:temperature
117 LOG_REQUEST_LIST uint8_t:target_system,target_component uint16_t:start,end
118 LOG_ENTRY uint16_t:id,num_logs,last_log_num uint32_t:time_utc,size
119 LOG_REQUEST_DATA uint8_t:target_system,target_component uint16_t:id uint32_t:ofs,count
120 LOG_DATA uint16_t:id uint32_t:ofs uint8_t:count uint8_t[90]:data
121 LOG_ERASE uint8_t:target_system,target_component
122 LOG_REQUEST_END uint8_t:target_system,target_component
123 GPS_INJECT_DATA uint8_t:target_system,target_component,len uint8_t[110]:data
124 GPS2_RAW uint64_t:time_usec uint8_t:fix_type int32_t:lat,lon,alt uint16_t:eph,epv,vel,cog uint8_t:satellites_visible,dgps_numch uint32_t:dgps_age | uint16_t:yaw int32_t:alt_ellipsoid uint32_t:h_acc,v_acc,vel_acc,hdg_acc
125 POWER_STATUS uint16_t:Vcc,Vservo,flags
126 SERIAL_CONTROL uint8_t:device,flags uint16_t:timeout uint32_t:baudrate uint8_t:count uint8_t[70]:data | uint8_t:target_system,target_component
127 GPS_RTK uint32_t:time_last_baseline_ms uint8_t:rtk_receiver_id uint16_t:wn uint32_t:tow uint8_t:rtk_health,rtk_rate,nsats,baseline_coords_type int32_t:baseline_a_mm,baseline_b_mm,baseline_c_mm uint32_t:accuracy int32_t:iar_num_hypotheses
128 GPS2_RTK uint32_t:time_last_baseline_ms uint8_t:rtk_receiver_id uint16_t:wn uint32_t:tow uint8_t:rtk_health,rtk_rate,nsats,baseline_coords_type int32_t:baseline_a_mm,baseline_b_mm,baseline_c_mm uint32_t:accuracy int32_t:iar_num_hypotheses
129 SCALED_IMU3 uint32_t:time_boot_ms int16_t:xacc,yacc,zacc,xgyro,ygyro,zgyro,xmag,ymag,zmag | int16_t:temperature
130 DATA_TRANSMISSION_HANDSHAKE uint8_t:type uint32_t:size uint16_t:width,height,packets uint8_t:payload,jpg_quality
131 ENCAPSULATED_DATA uint16_t:seqnr uint8_t[253]:data
132 DISTANCE_SENSOR uint32_t:time_boot_ms uint16_t:min_distance,max_distance,current_distance uint8_t:type,id,orientation,covariance | float:horizontal_fov,vertical_fov float[4]:quaternion uint8_t:signal_quality
133 TERRAIN_REQUEST int32_t:lat,lon uint16_t:grid_spacing uint64_t:mask
134 TERRAIN_DATA int32_t:lat,lon uint16_t:grid_spacing uint8_t:gridbit int16_t[16]:data
135 TERRAIN_CHECK int32_t:lat,lon
136 TERRAIN_REPORT int32_t:lat,lon uint16_t:spacing float:terrain_height,current_height uint16_t:pending,loaded
137 SCALED_PRESSURE2 uint32_t:time_boot_ms float:press_abs,press_diff int16_t:temperature | int16_t:temperature_press_diff
138 ATT_POS_MOCAP uint64_t:time_usec float[4]:q float:x,y,z | float[21]:covariance
139 SET_ACTUATOR_CONTROL_TARGET uint64_t:time_usec uint8_t:group_mlx,target_system,target_component float[8]:controls
140 ACTUATOR_CONTROL_TARGET uint64_t:time_usec uint8_t:group_mlx float[8]:controls
141 ALTITUDE uint64_t:time_usec float:altitude_monotonic,altitude_amsl,altitude_local,altitude_relative,altitude_terrain,bottom_clearance
142 RESOURCE_REQUEST uint8_t:request_id,uri_type uint8_t[120]:uri uint8_t:transfer_type uint8_t[120]:storage
143 SCALED_PRESSURE3 uint32_t:time_boot_ms float:press_abs,press_diff int16_t:temperature | int16_t:temperature_press_diff
144 FOLLOW_TARGET uint64_t:timestamp uint8_t:est_capabilities int32_t:lat,lon float:alt float[3]:vel,acc float[4]:attitude_q float[3]:rates,position_cov uint64_t:custom_state
146 CONTROL_SYSTEM_STATE uint64_t:time_usec float:x_acc,y_acc,z_acc,x_vel,y_vel,z_vel,x_pos,y_pos,z_pos,airspeed float[3]:vel_variance,pos_variance float[4]:q float:roll_rate,pitch_rate,yaw_rate
147 BATTERY_STATUS uint8_t:id,battery_function,type int16_t:temperature uint16_t[10]:voltages int16_t:current_battery int32_t:current_consumed,energy_consumed int8_t:battery_remaining | int32_t:time_remaining uint8_t:charge_state uint16_t[4]:voltages_ext uint8_t:mode uint32_t:fault_bitmask
148 AUTOPILOT_VERSION uint64_t:capabilities uint32_t:flight_sw_version,middleware_sw_version,os_sw_version,board_version uint8_t[8]:flight_custom_version,middleware_custom_version,os_custom_version uint16_t:vendor_id,product_id uint64_t:uid | uint8_t[18]:uid2
149 LANDING_TARGET uint64_t:time_usec uint8_t:target_num,frame float:angle_x,angle_y,distance,size_x,size_y | float:x,y,z float[4]:q uint8_t:type,position_valid
150 SENSOR_OFFSETS int16_t:mag_ofs_x,mag_ofs_y,mag_ofs_z float:mag_declination int32_t:raw_press,raw_temp float:gyro_cal_x,gyro_cal_y,gyro_cal_z,accel_cal_x,accel_cal_y,accel_cal_z
151 SET_MAG_OFFSETS uint8_t:target_system,target_component int16_t:mag_ofs_x,mag_ofs_y,mag_ofs_z
152 MEMINFO uint16_t:brkval,freemem | uint32_t:freemem32
153 AP_ADC uint16_t:adc1,adc2,adc3,adc4,adc5,adc6
154 DIGICAM_CONFIGURE uint8_t:target_system,target_component,mode uint16_t:shutter_speed uint8_t:aperture,iso,exposure_type,command_id,engine_cut_off,extra_param float:extra_value
155 DIGICAM_CONTROL uint8_t:target_system,target_component,session,zoom_pos int8_t:zoom_step uint8_t:focus_lock,shot,command_id,extra_param float:extra_value
156 MOUNT_CONFIGURE uint8_t:target_system,target_component,mount_mode,stab_roll,stab_pitch,stab_yaw
157 MOUNT_CONTROL uint8_t:target_system,target_component int32_t:input_a,input_b,input_c uint8_t:save_position
158 MOUNT_STATUS uint8_t:target_system,target_component int32_t:pointing_a,pointing_b,pointing_c | uint8_t:mount_mode
160 FENCE_POINT uint8_t:target_system,target_component,idx,count float:lat,lng
161 FENCE_FETCH_POINT uint8_t:target_system,target_component,idx
162 FENCE_STATUS uint8_t:breach_status uint16_t:breach_count uint8_t:breach_type uint32_t:breach_time | uint8_t:breach_mitigation
163 AHRS float:omegaIx,omegaIy,omegaIz,accel_weight,renorm_val,error_rp,error_yaw
164 SIMSTATE float:roll,pitch,yaw,xacc,yacc,zacc,xgyro,ygyro,zgyro int32_t:lat,lng
165 HWSTATUS uint16_t:Vcc uint8_t:I2Cerr
166 RADIO uint8_t:rssi,remrssi,txbuf,noise,remnoise uint16_t:rxerrors,fixed
167 LIMITS_STATUS uint8_t:limits_state uint32_t:last_trigger,last_action,last_recovery,last_clear uint16_t:breach_count uint8_t:mods_enabled,mods_required,mods_triggered
168 WIND float:direction,speed,speed_z
169 DATA16 uint8_t:type,len uint8_t[16]:data
170 DATA32 uint8_t:type,len uint8_t[32]:data
171 DATA64 uint8_t:type,len uint8_t[64]:data
172 DATA96 uint8_t:type,len uint8_t[96]:data
173 RANGEFINDER float:distance,voltage
174 AIRSPEED_AUTOCAL float:vx,vy,vz,diff_pressure,EAS2TAS,ratio,state_x,state_y,state_z,Pax,Pby,Pcz
175 RALLY_POINT uint8_t:target_system,target_component,idx,count int32_t:lat,lng int16_t:alt,break_alt uint16_t:land_dir uint8_t:flags
176 RALLY_FETCH_POINT uint8_t:target_system,target_component,idx
177 COMPASSMOT_STATUS uint16_t:throttle float:current uint16_t:interference float:CompensationX,CompensationY,CompensationZ
178 AHRS2 float:roll,pitch,yaw,altitude int32_t:lat,lng
179 CAMERA_STATUS uint64_t:time_usec uint8_t:target_system,cam_idx uint16_t:img_idx uint8_t:event_id float:p1,p2,p3,p4
180 CAMERA_FEEDBACK uint64_t:time_usec uint8_t:target_system,cam_idx uint16_t:img_idx int32_t:lat,lng float:alt_msl,alt_rel,roll,pitch,yaw,foc_len uint8_t:flags | uint16_t:completed_captures
181 BATTERY2 uint16_t:voltage int16_t:current_battery
182 AHRS3 float:roll,pitch,yaw,altitude int32_t:lat,lng float:v1,v2,v3,v4
183 AUTOPILOT_VERSION_REQUEST uint8_t:target_system,target_component
184 REMOTE_LOG_DATA_BLOCK uint8_t:target_system,target_component uint32_t:seqno uint8_t[200]:data
185 REMOTE_LOG_BLOCK_STATUS uint8_t:target_system,target_component uint32_t:seqno uint8_t:status
186 LED_CONTROL uint8_t:target_system,target_component,instance,pattern,custom_len uint8_t[24]:custom_bytes
191 MAG_CAL_PROGRESS uint8_t:compass_id,cal_mask,cal_status,attempt,completion_pct uint8_t[10]:completion_mask float:direction_x,direction_y,direction_z
192 MAG_CAL_REPORT uint8_t:compass_id,cal_mask,cal_status,autosaved float:fitness,ofs_x,ofs_y,ofs_z,diag_x,diag_y,diag_z,offdiag_x,offdiag_y,offdiag_z | float:orientation_confidence uint8_t:old_orientation,new_orientation float:scale_factor
193 EKF_STATUS_REPORT uint16_t:flags float:velocity_variance,pos_horiz_variance,pos_vert_variance,compass_variance,terrain_alt_variance | float:airspeed_variance
194 PID_TUNING uint8_t:axis float:desired,achieved,FF,P,I,D | float:SRate,PDmod
195 DEEPSTALL int32_t:landing_lat,landing_lon,path_lat,path_lon,arc_entry_lat,arc_entry_lon float:altitude,expected_travel_distance,cross_track_error uint8_t:stage
200 GIMBAL_REPORT uint8_t:target_system,target_component float:delta_time,delta_angle_x,delta_angle_y,delta_angle_z,delta_velocity_x,delta_velocity_y,delta_velocity_z,joint_roll,joint_el,joint_az
201 GIMBAL_CONTROL uint8_t:target_system,target_component float:demanded_rate_x,demanded_rate_y,demanded_rate_z
214 GIMBAL_TORQUE_CMD_REPORT uint8_t:target_system,target_component int16_t:rl_torque_cmd,el_torque_cmd,az_torque_cmd
215 GOPRO_HEARTBEAT uint8_t:status,capture_mode,flags
216 GOPRO_GET_REQUEST uint8_t:target_system,target_component,cmd_id
217 GOPRO_GET_RESPONSE uint8_t:cmd_id,status uint8_t[4]:value
218 GOPRO_SET_REQUEST uint8_t:target_system,target_component,cmd_id uint8_t[4]:value
219 GOPRO_SET_RESPONSE uint8_t:cmd_id,status
226 RPM float:rpm1,rpm2
230 ESTIMATOR_STATUS uint64_t:time_usec uint16_t:flags float:vel_ratio,pos_horiz_ratio,pos_vert_ratio,mag_ratio,hagl_ratio,tas_ratio,pos_horiz_accuracy,pos_vert_accuracy
231 WIND_COV uint64_t:time_usec float:wind_x,wind_y,wind_z,var_horiz,var_vert,wind_alt,horiz_accuracy,vert_accuracy
232 GPS_INPUT uint64_t:time_usec uint8_t:gps_id uint16_t:ignore_flags uint32_t:time_week_ms uint16_t:time_week uint8_t:fix_type int32_t:lat,lon float:alt,hdop,vdop,vn,ve,vd,speed_accuracy,horiz_accuracy,vert_accuracy uint8_t:satellites_visible | uint16_t:yaw
233 GPS_RTCM_DATA uint8_t:flags,len uint8_t[180]:data
234 HIGH_LATENCY uint8_t:base_mode uint32_t:custom_mode uint8_t:landed_state int16_t:roll,pitch uint16_t:heading int8_t:throttle int16_t:heading_sp int32_t:latitude,longitude int16_t:altitude_amsl,altitude_sp uint8_t:airspeed,airspeed_sp,groundspeed int8_t:climb_rate uint8_t:gps_nsat,gps_fix_type,battery_remaining int8_t:temperature,temperature_air uint8_t:failsafe,wp_num uint16_t:wp_distance
235 HIGH_LATENCY2 uint32_t:timestamp uint8_t:type,autopilot uint16_t:custom_mode int32_t:latitude,longitude int16_t:altitude,target_altitude uint8_t:heading,target_heading uint16_t:target_distance uint8_t:throttle,airspeed,airspeed_sp,groundspeed,windspeed,wind_heading,eph,epv int8_t:temperature_air,climb_rate,battery uint16_t:wp_num,failure_flags int8_t:custom0,custom1,custom2
241 VIBRATION uint64_t:time_usec float:vibration_x,vibration_y,vibration_z uint32_t:clipping_0,clipping_1,clipping_2
242 HOME_POSITION int32_t:latitude,longitude,altitude float:x,y,z float[4]:q float:approach_x,approach_y,approach_z | uint64_t:time_usec
243 SET_HOME_POSITION uint8_t:target_system int32_t:latitude,longitude,altitude float:x,y,z float[4]:q float:approach_x,approach_y,approach_z | uint64_t:time_usec
244 MESSAGE_INTERVAL uint16_t:message_id int32_t:interval_us
245 EXTENDED_SYS_STATE uint8_t:vtol_state,landed_state
246 ADSB_VEHICLE uint32_t:ICAO_address int32_t:lat,lon uint8_t:altitude_type int32_t:altitude uint16_t:heading,hor_velocity int16_t:ver_velocity char[9]:callsign uint8_t:emitter_type,tslc uint16_t:flags,squawk
247 COLLISION uint8_t:src uint32_t:id uint8_t:action,threat_level float:time_to_minimum_delta,altitude_minimum_delta,horizontal_minimum_delta
248 V2_EXTENSION uint8_t:target_network,target_system,target_component uint16_t:message_type uint8_t[249]:payload
249 MEMORY_VECT uint16_t:address uint8_t:ver,type int8_t[32]:value
250 DEBUG_VECT char[10]:name uint64_t:time_usec float:x,y,z
251 NAMED_VALUE_FLOAT uint32_t:time_boot_ms char[10]:name float:value
252 NAMED_VALUE_INT uint32_t:time_boot_ms char[10]:name int32_t:value
253 STATUSTEXT uint8_t:severity char[50]:text | uint16_t:id uint8_t:chunk_seq
254 DEBUG uint32_t:time_boot_ms uint8_t:ind float:value
256 SETUP_SIGNING uint8_t:target_system,target_component uint8_t[32]:secret_key uint64_t:initial_timestamp
257 BUTTON_CHANGE uint32_t:time_boot_ms,last_change_ms uint8_t:state
258 PLAY_TUNE uint8_t:target_system,target_component char[30]:tune | char[200]:tune2
259 CAMERA_INFORMATION uint32_t:time_boot_ms uint8_t[32]:vendor_name,model_name uint32_t:firmware_version float:focal_length,sensor_size_h,sensor_size_v uint16_t:resolution_h,resolution_v uint8_t:lens_id uint32_t:flags uint16_t:cam_definition_version char[140]:cam_definition_uri | uint8_t:gimbal_device_id
260 CAMERA_SETTINGS uint32_t:time_boot_ms uint8_t:mode_id | float:zoomLevel,focusLevel
261 STORAGE_INFORMATION uint32_t:time_boot_ms uint8_t:storage_id,storage_count,status float:total_capacity,used_capacity,available_capacity,read_speed,write_speed | uint8_t:type char[32]:name uint8_t:storage_usage
262 CAMERA_CAPTURE_STATUS uint32_t:time_boot_ms uint8_t:image_status,video_status float:image_interval uint32_t:recording_time_ms float:available_capacity | int32_t:image_count
263 CAMERA_IMAGE_CAPTURED uint32_t:time_boot_ms uint64_t:time_utc uint8_t:camera_id int32_t:lat,lon,alt,relative_alt float[4]:q int32_t:image_index int8_t:capture_result char[205]:file_url
264 FLIGHT_INFORMATION uint32_t:time_boot_ms uint64_t:arming_time_utc,takeoff_time_utc,flight_uuid
265 MOUNT_ORIENTATION uint32_t:time_boot_ms float:roll,pitch,yaw | float:yaw_absolute
266 LOGGING_DATA uint8_t:target_system,target_component uint16_t:sequence uint8_t:length,first_message_offset uint8_t[249]:data
267 LOGGING_DATA_ACKED uint8_t:target_system,target_component uint16_t:sequence uint8_t:length,first_message_offset uint8_t[249]:data
268 LOGGING_ACK uint8_t:target_system,target_component uint16_t:sequence
269 VIDEO_STREAM_INFORMATION uint8_t:stream_id,count,type uint16_t:flags float:framerate uint16_t:resolution_h,resolution_v uint32_t:bitrate uint16_t:rotation,hfov char[32]:name char[160]:uri
270 VIDEO_STREAM_STATUS uint8_t:stream_id uint16_t:flags float:framerate uint16_t:resolution_h,resolution_v uint32_t:bitrate uint16_t:rotation,hfov
299 WIFI_CONFIG_AP char[32]:ssid char[64]:password
300 PROTOCOL_VERSION uint16_t:version,min_version,max_version uint8_t[8]:spec_version_hash,library_version_hash
310 UAVCAN_NODE_STATUS uint64_t:time_usec uint32_t:uptime_sec uint8_t:health,mode,sub_mode uint16_t:vendor_specific_status_code
311 UAVCAN_NODE_INFO uint64_t:time_usec uint32_t:uptime_sec char[80]:name uint8_t:hw_version_major,hw_version_minor uint8_t[16]:hw_unique_id uint8_t:sw_version_major,sw_version_minor uint32_t:sw_vcs_commit
320 PARAM_EXT_REQUEST_READ uint8_t:target_system,target_component char[16]:param_id int16_t:param_index
321 PARAM_EXT_REQUEST_LIST uint8_t:target_system,target_component
322 PARAM_EXT_VALUE char[16]:param_id char[128]:param_value uint8_t:param_type uint16_t:param_count,param_index
323 PARAM_EXT_SET uint8_t:target_system,target_component char[16]:param_id char[128]:param_value uint8_t:param_type
324 PARAM_EXT_ACK char[16]:param_id char[128]:param_value uint8_t:param_type,param_result
330 OBSTACLE_DISTANCE uint64_t:time_usec uint8_t:sensor_type uint16_t[72]:distances uint8_t:increment uint16_t:min_distance,max_distance | float:increment_f,angle_offset uint8_t:frame
331 ODOMETRY uint64_t:time_usec uint8_t:frame_id,child_frame_id float:x,y,z float[4]:q float:vx,vy,vz,rollspeed,pitchspeed,yawspeed float[21]:pose_covariance,velocity_covariance | uint8_t:reset_counter,estimator_type int8_t:quality
11000 DEVICE_OP_READ uint8_t:target_system,target_component uint32_t:request_id uint8_t:bustype,bus,address char[40]:busname uint8_t:regstart,count | uint8_t:bank
11001 DEVICE_OP_READ_REPLY uint32_t:request_id uint8_t:result,regstart,count uint8_t[128]:data | uint8_t:bank
11002 DEVICE_OP_WRITE uint8_t:target_system,target_component uint32_t:request_id uint8_t:bustype,bus,address char[40]:busname uint8_t:regstart,count uint8_t[128]:data | uint8_t:bank
11003 DEVICE_OP_WRITE_REPLY uint32_t:request_id uint8_t:result
11010 ADAP_TUNING uint8_t:axis float:desired,achieved,error,theta,omega,sigma,theta_dot,omega_dot,sigma_dot,f,f_dot,u
11011 VISION_POSITION_DELTA uint64_t:time_usec,time_delta_usec float[3]:angle_delta,position_delta float:confidence
11020 AOA_SSA uint64_t:time_usec float:AOA,SSA
11030 ESC_TELEMETRY_1_TO_4 uint8_t[4]:temperature uint16_t[4]:voltage,current,totalcurrent,rpm,count
11031 ESC_TELEMETRY_5_TO_8 uint8_t[4]:temperature uint16_t[4]:voltage,current,totalcurrent,rpm,count
11032 ESC_TELEMETRY_9_TO_12 uint8_t[4]:temperature uint16_t[4]:voltage,current,totalcurrent,rpm,count
"""


@dataclass(frozen=True)
class Message:
    seed: int
    least: int
    most: int


def _message(name: str, fields: list[tuple[str, str, bool]]) -> Message:
    """fields: (type, name, extension)."""
    parsed = []
    for kind, field, extension in fields:
        kind = "uint8_t" if kind == "uint8_t_mavlink_version" else kind
        m = re.fullmatch(r"(\w+)(?:\[(\d+)\])?", kind)
        parsed.append((m[1], int(m[2] or 0), field, extension, SIZES[m[1]]))
    base = sorted((p for p in parsed if not p[3]), key=lambda p: -p[4])
    crc = mcrf4xx(f"{name} ".encode())
    for kind, length, field, _, _ in base:
        crc = mcrf4xx(f"{kind} {field} ".encode(), crc)
        if length:
            crc = mcrf4xx(bytes([length]), crc)
    size = lambda some: sum(s * (n or 1) for _, n, _, _, s in some)
    return Message(crc & 0xFF ^ crc >> 8, size(base), size(parsed))


def from_text(text: str) -> dict[int, Message]:
    out = {}
    for line in text.strip().splitlines():
        number, name, *rest = line.split()
        fields, extension = [], False
        for item in rest:
            if item == "|":
                extension = True
            else:
                kind, named = item.split(":")
                fields += [(kind, field, extension) for field in named.split(",")]
        out[int(number)] = _message(name, fields)
    return out


def from_xml(*paths: str | Path) -> dict[int, Message]:
    """A dialect from message definition files; includes must be passed as well."""
    out = {}
    for path in paths:
        for node in ET.parse(path).getroot().iter("message"):
            fields, extension = [], False
            for child in node:
                if child.tag == "extensions":
                    extension = True
                elif child.tag == "field":
                    fields.append((child.attrib["type"], child.attrib["name"], extension))
            out[int(node.attrib["id"])] = _message(node.attrib["name"], fields)
    return out


CORE_DIALECT = from_text(CORE)
